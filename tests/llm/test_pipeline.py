"""run() against a plain Python pipeline, stage by stage, and the stages on odd tables."""
import struct

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as p
import reqsight.llm.queries as q
from reqsight.llm import quality
from tests.llm.brute import classes, contamination, fingerprint

SF = "/root/testdata/sf0.001"


def expected(spark, rows):
    model = quality.train(quality.sample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    rows = [r for r in rows if quality.score(model, r[1]) >= 0.5]
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, -1))
    rows = [r for r in rows if last[r[1]] == r[0]]
    fp = [fingerprint(t) for _, t in rows]
    root = classes(len(rows), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[root[k]] = min(i, first.get(root[k], i))
    rows = [r for k, r in enumerate(rows) if first[root[k]] == r[0]]
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    bad = {i for i, _, hits, _ in contamination(rows, items) if hits}
    return [r for r in rows if r[0] not in bad]


def test_run_matches_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = expected(spark, docs)
    library = Tokenizer.from_file(q.tokenizer_path())
    library.no_truncation(), library.no_padding()
    got = {r.doc_id: r for r in p.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in want} and 0 < len(want) < len(docs)
    for i, t in want:
        ids = library.encode(t, add_special_tokens=False).ids
        assert bytes(got[i].ids) == struct.pack(f"<{len(ids)}I", *ids) and got[i].n_tokens == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name, stage", p.STAGES)
def test_stages_on_odd_tables(spark, edge, nothing, name, stage):
    assert stage(spark, nothing, SF).count() == 0
    out = stage(spark, edge, SF)
    rows = out.collect()
    assert 0 < len(rows) <= edge.count()
    if name != "bpe_encoding":
        assert out.columns == edge.columns
    else:
        assert len(rows) == edge.count()
