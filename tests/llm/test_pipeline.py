"""The pipeline on a small folder, stage by stage, each judged on its own input."""
import random

import brute
from tokenizers import Tokenizer

import corpus_pipeline
from prudens.llm import queries


def test_stages(spark, tmp_path, word_bpe):
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["BUY!!", "$$$", "%%%", "||"]) + rng.choice(["ABC", "DEF", "XY"]) for _ in range(n))
    rows = [(i, line(rng.randint(20, 120)) if i % 4 else junk(rng.randint(20, 120))) for i in range(400)]
    clean = dict(rows)
    shared, item = line(70), line(30)
    rows += [(1000, clean[1]), (1001, clean[2] + " x"), (1002, line(30) + " " + shared), (1003, shared + " " + line(40)), (1004, line(40) + " " + item + " " + line(9))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, line(30)), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        assert k == 4 or at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/out{k}")
        at = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append({r.doc_id: r for r in at.collect()})
    good = {i for i, _ in rows if i >= 400 or i % 4}
    assert len(good - set(seen[0])) <= 2 and len(set(seen[0]) - good) <= 2
    texts = [(i, r.text) for i, r in seen[0].items()]
    assert set(seen[1]) == {i for i, _, c, _ in brute.near(texts, 80) if i == c} and 1000 not in seen[1] and 1001 not in seen[1]
    assert set(seen[2]) == set(seen[1]) and {i: len(seen[2][i].text.encode()) for i in seen[2]} == {i: n - gone for i, n, gone, _, _ in brute.suffix([(i, r.text) for i, r in seen[1].items()])}
    assert shared not in seen[2][1002].text + seen[2][1003].text
    assert set(seen[2]) - set(seen[3]) == {1004}
    lib = Tokenizer.from_file(word_bpe)
    assert {i: list(r.ids) for i, r in seen[4].items()} == {i: lib.encode(r.text, add_special_tokens=False).ids for i, r in seen[3].items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])
    assert sum(k.startswith("op") for k in queries.QUERIES) == 13


