import sys
from collections import Counter

import pytest

import corpus_pipeline as cp
from lodestrata.llm import packing
from lodestrata.llm.toxicity import score_toxicity

from .test_packing import verify
from .test_probminhash import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_against_its_input(spark, sf_dir, stages):
    docs, clean, unique, mixed, packed = stages
    assert clean.columns == unique.columns == mixed.columns == docs.columns
    toxic = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    assert ids(clean) == [i for i in ids(docs) if i not in toxic]
    classes = brute([(r.doc_id, r.text) for r in clean.collect()])
    assert ids(unique) == sorted(set(classes.values()))
    assert Counter(ids(mixed)).most_common(1)[0][1] == 1 and set(ids(mixed)) < set(ids(unique))
    from tokenizers import Tokenizer

    verify(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()], Tokenizer.from_file(packing.default_paths()[0]))


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    whole = cp.run(spark, sf_dir)
    assert sum(r[2] for r in key(whole)) == sum(r[2] for r in key(stages[-1]))
    assert {r[0] for r in key(whole)} == {r[0] for r in key(stages[-1])}
    assert "corpus_pipeline" in sys.modules


CLASH = {c: f"'{c}'" for c in ("score", "evidence", "predicted", "held_out", "row", "key", "kept", "gone", "n_rows", "class_id", "band", "mix_domain", "mix_tokens", "mix_epoch", "_cut", "_key", "_bucket", "_d", "domain", "tokens", "epoch", "queue", "chunk", "task", "at", "ids", "first", "time", "__text")}


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("edge")
    rows = [(i, f"{'foul' if i % 4 == 1 else 'fair'} words of text number {i} here " * (1 + i % 5), "en", f"s{i % 3}") for i in range(80)]
    rows += [(200, None, "en", "s1"), (201, "", None, None), (None, "no id at all in this row", "en", "s1"), (None, "no id at all in this row", "en", "s1"), (None, None, None, None)]
    rows += [rows[2], rows[2], (3, "the same id and another text", "de", "s2"), (202, "long words " * 30_000, "fr", ""), (203, rows[6][1], "en", "s1")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.selectExpr("*", *[f"{v} AS `{c}`" for c, v in CLASH.items()]).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(80)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stage_with_clashing_names_nulls_and_repeats(spark, edge_dir, name, stage):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = stage(spark, docs, edge_dir)
    got = out.collect()
    assert stage(spark, docs.limit(0), edge_dir).count() == 0
    if name == "packing":
        from tokenizers import Tokenizer

        verify(got, [(r.doc_id, r.text) for r in docs.collect()], Tokenizer.from_file(packing.default_paths()[0]))
        return
    assert out.columns == docs.columns
    assert all(r[c] == c for r in got for c in CLASH)
    there = Counter((r.doc_id, r.text) for r in docs.collect())
    kept = Counter((r.doc_id, r.text) for r in got)
    assert not kept - there
    if name == "toxicity":
        assert not any("foul" in (t or "") for _, t in kept) and sum((there - kept).values()) == sum("foul" in (t or "") for _, t in there.elements())
    if name == "near_duplicates":
        by_id = Counter(i for (i, _), n in kept.items() for _ in range(n))
        assert max(n for i, n in by_id.items() if i is not None) == 1 and by_id[None] == 2 and by_id[203] == 0 and by_id[200] == by_id[202] == 1


def test_run_on_clashing_names_and_releases(spark, edge_dir):
    import glob

    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{root}/lodestrata/*"))
    assert cp.run(spark, edge_dir).count() > 0
    left = [x for x in set(glob.glob(f"{root}/lodestrata/*")) - before]
    assert all("/pack-" in x or "/pack" in x or "pipeline-mixing" in x for x in left)


def test_tidy_lets_finished_shuffles_go(spark):
    """Files of a shuffle whose job is done are gone soon after ``tidy``."""
    import time

    from lodestrata.llm.common import materialise, release, tidy

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(found.apply(k).getName().startswith("shuffle_") for k in range(found.size()))

    tidy(spark)
    time.sleep(1)
    before = files()
    held = materialise(spark.range(20_000).selectExpr("id % 997 as k", "id").repartition(4, "k").mapInArrow(lambda b: b, "k long, id long"), "tidy")
    assert files() > before
    tidy(spark)
    time.sleep(1)
    assert files() <= before
    release(held)
