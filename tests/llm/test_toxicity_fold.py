import pytest

from parchment.llm import toxicity


@pytest.mark.parametrize("text, folded", [
    ("1d10t", "idiot"), ("a55hole", "asshole"), ("l053r", "loser"), ("b17ch", "bitch"), ("idi07", "idiot"), ("a$$", "ass"), ("$h!t", "shit"),
    ("idi07!! stop!", "idiot stop"), ("100 7! 4", ""), ("well! 50 of them", "well of them"),
])
def test_runs_of_signs_fold(text, folded):
    assert toxicity.fold(text).strip() == folded


def test_disguised_words_match_their_stems():
    a = toxicity.Lexicon({"idio": 2.0, "asshol": 1.0}).automaton()
    assert toxicity.weigh(toxicity.fold("you 1d10t a55hole idi07"), a) == (5.0, 4)
