import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers as P
from findery.llm.common import saved
from tokenizers import Tokenizer

HEX = "9fceb02d0ae598e95dc970b74767f19372d61af8"


def test_registration():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "secret scans", "packing"]


def test_stages_one_after_another(spark, tmp_path):
    import random

    r = random.Random(6)
    sentence = lambda: " ".join(r.choice(["the", "of", "and", f"word{r.randint(0, 80)}"]) for _ in range(9)).capitalize() + "."
    text = lambda n: " ".join(sentence() for _ in range(n))
    passage = " ".join(" ".join(f"p{i}{k}" for k in range(8)).capitalize() + "." for i in range(8))
    rows = [(i, text(12), "en", "s", 0) for i in range(80)]
    rows += [(100, rows[0][1] + " The end.", "en", "s", 0), (101, rows[1][1], "en", "s", 0)]
    rows += [(110, text(12) + " " + passage, "en", "s", 0), (111, passage + " " + text(12), "en", "s", 0)]
    rows += [(120, text(10) + f' token = "{HEX}" ' + text(4), "en", "s", 0), (130, " ".join(f"{w}###" for w in text(12).split()), "en", "s", 0), (140, None, None, None, None), (141, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in [*range(80), 110, 111]] + [(130, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: {x.doc_id for x in df.collect()}
    one = saved(stage["quality classifier"](spark, at, str(tmp_path)))
    assert one.columns == docs.columns and ids(at) - ids(one) == {130, 140, 141}
    two = saved(stage["n-gram Jaccard join"](spark, one, str(tmp_path)))
    assert two.columns == docs.columns and ids(one) - ids(two) == {100, 101}
    three = saved(stage["substring dedup"](spark, two, str(tmp_path)))
    texts = {x.doc_id: x.text for x in three.collect()}
    assert three.columns == docs.columns and set(texts) == ids(two)
    assert "P00 p01" in texts[110] and "p3" not in texts[111].lower().split("word")[0]
    four = saved(stage["secret scans"](spark, three, str(tmp_path)))
    last = {x.doc_id: x for x in four.collect()}
    assert HEX not in last[120].text and "[secret]" in last[120].text and last[120].n_chars == len(last[120].text)
    pieces = stage["packing"](spark, four, str(tmp_path)).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == {i: len(t.encode(x.text, add_special_tokens=False).ids) + 1 for i, x in last.items()}
    assert {(p.doc_id, p.ids_crc32) for p in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(p.doc_id, p.ids_crc32) for p in pieces}
