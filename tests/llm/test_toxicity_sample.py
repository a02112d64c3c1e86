import random
import zlib

from pyspark.sql import functions as F

from parchment.llm import toxicity


def test_learns_from_texts_that_share_a_word(spark):
    """Every text holds the word with the smallest hash; only real copies count once."""
    rnd = random.Random(4)
    common = [f"plain{i}" for i in range(300)]
    least = spark.range(200_000).select(F.concat(F.lit("w"), "id").alias("w")).orderBy(F.xxhash64("w")).first().w
    rows = []
    for i in range(300):
        words = [rnd.choice(common) for _ in range(30)] + common[:39] + [least]
        rnd.shuffle(words)
        if i % 3 == 0:
            words.append("grobian")
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    copies = [(1000 + i, f"{rows[1][1]} vermin", 1) for i in range(30)]  # near copies of one clean text
    docs = spark.createDataFrame([x[:2] for x in rows + copies], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows + copies], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    assert any("grobian".startswith(s) for s in lexicon.weights) and not any(s.startswith("verm") for s in lexicon.weights)
    found = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, lexicon).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert all(found[i] == bool(y) for i, _, y in held)
