import pytest

import corpus_pipeline
from millrace.llm import registry
from tests.llm.test_operators import BASE, ROWS, long_text

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_and_give_documents(spark, tmp_path):
    rows = [(k, long_text(k, 60 + k), "en" if k % 3 else "fr", f"s{k % 4}", 0) for k in range(30)] + [(100 + k, BASE if k % 2 else BASE + " tail", "en", "s0", 0) for k in range(4)] + [(200 + r[0], *r[1:]) for r in ROWS if r[0] is not None and r[0] < 5]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        out = str(tmp_path / name)
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "sentencepiece":
            assert docs.columns == COLUMNS
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert set(range(30)) <= kept["language_id"] and not kept["language_id"] & {200, 201, 202}
    assert kept["jaccard_join"] & {100, 101, 102, 103} == {100}
    assert docs.columns == ["doc_id", "ids", "n_tokens"] and docs.filter("size(ids) <> n_tokens").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


WIDE = "doc_id long, text string, lang string, source string, n_chars long, n_bytes string, kept string, taken string, lang_pred string, score string, ids string, component_id string"
EXTRAS = ["n_bytes", "kept", "taken", "lang_pred", "score", "ids", "component_id"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_null_and_clashing_rows(spark, name, stage):
    english, french = "the cat sat on the mat " * 9, "le chat dort sur la table " * 9
    rows = [(1, english, "en", "a", 0), (1, english, "en", "a", 0), (None, None, None, None, None), (3, "", "fr", None, None), (None, french, "fr", None, 5)]
    nothing = stage(spark, spark.createDataFrame([], WIDE), "")
    assert nothing.count() == 0
    docs = spark.createDataFrame([(*r, *(f"{n}{k}" for n in EXTRAS)) for k, r in enumerate(rows)], WIDE)
    out = stage(spark, docs, "")
    got = out.collect()
    if name == "sentencepiece":
        assert out.columns == nothing.columns == ["doc_id", "ids", "n_tokens"] and len(got) == len(rows)
        assert sorted(r.n_tokens for r in got)[:2] == [1, 1]
        return
    assert out.schema.simpleString() == nothing.schema.simpleString() == docs.schema.simpleString()
    assert all([r[n][len(n) :] for n in EXTRAS] == [r.n_bytes[len("n_bytes") :]] * len(EXTRAS) for r in got)
    kept = sorted({int(r.n_bytes[len("n_bytes") :]) for r in got})
    assert {"language_id": [0, 1, 4], "jaccard_join": [0, 1, 2, 3, 4], "suffix_dedup": [0, 1, 2, 3, 4]}.get(name, kept) == kept
    if name == "source_mixing":
        assert kept and not set(kept) & {2, 3}


def test_strings_are_removed_without_a_count_of_characters(spark):
    docs = spark.createDataFrame([(1, BASE), (2, BASE)], "doc_id long, text string")
    assert [r.text == BASE for r in corpus_pipeline.remove_repeated_strings(spark, docs, "").orderBy("doc_id").collect()] == [True, len(BASE) < 100]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
