"""The queries whose SQL there is, the pipeline against its stages, and the import guard."""

import pathlib
import shutil
import subprocess
import sys

import pytest

import corpus_pipeline
from siltbed.llm import queries

from ..conftest import rows_of
from .conftest import SCHEMA, edge_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, spark, sf_dir, duck):
    mine, other = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns) and len(mine) == len(other)
    assert rows_of(mine) == rows_of(other)


def test_pipeline(spark, sf_dir):
    """Plain versions of what stages may do: nothing is lost but what they reject."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = {r["doc_id"]: r for r in docs.collect()}
    sizes = [len(start)]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in now.collect()}
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns, name
        rows = now.collect()
        now = spark.createDataFrame(rows, SCHEMA)
        assert {r["doc_id"] for r in rows} <= set(before)
        for r in rows:
            was = before[r["doc_id"]]
            assert r["n_chars"] == len(r["text"])
            assert set(r["text"].split("\n")) <= set(was["text"].split("\n"))
            assert name == "line dedup" or r["text"] == was["text"]
        sizes.append(len({r["doc_id"] for r in rows}))
    assert sizes[1] >= 0.97 * sizes[0] and sizes[2] == sizes[1] and sizes[3] >= 0.8 * sizes[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in rows}
    run = corpus_pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run[key].to_numpy())) == sorted(map(tuple, packed[key].to_numpy()))


def test_pipeline_edges(spark, tmp_path):
    for k, rows in enumerate((edge_rows(), [])):
        full = [(i, t, la, s, len(t) if t is not None else None) for i, t, la, s in rows]
        spark.createDataFrame(full, SCHEMA).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        found = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()}
        assert found <= {4, 6, 7, 8} and (4 in found) == bool(rows)


def test_entry_imports_without_the_subpackage(tmp_path):
    root = pathlib.Path(__file__).parents[2]
    shutil.copytree(root / "siltbed", tmp_path / "siltbed", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kv_put_latest' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
