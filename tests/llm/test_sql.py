"""The corpus queries that have SQL against DuckDB, on the smallest tables and on awkward texts."""

import os

import duckdb
import pytest

from lumispec.llm import licenses, quality, queries

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TEXTS = [
    None,
    "",
    " \n\t ",
    "CC BY cc-by, All rights RESERVED. all rights reserved",
    "General Public License version 3. This work is licensed under the GNU General Public License version 3 or later",
    "license version 3 0 licensed under the apache license, version 2.0; not under version 1.1",
    "mit license", "released under the MIT license", "the mit license the mit license",
    "a b c a b c a b c\n\na b c\nHome\n» Weiter | lesen | hier | dort\nWer «A» und »B« sagt",
    "word!! word!! word??\n*** &&& $$\n---\nPrivacy Policy applies\n" + "plain words that stay here and are many enough to count " * 9,
    "x\x0b y\x0c z\r\nx y z",
]


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(queries.QUERIES[name](spark, SF), db.execute(queries.ORACLE[name]))


@pytest.mark.parametrize("name", ["op6_license_scans", "op8_quality_rules"])
def test_awkward_texts(spark, name):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (None, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {"op6_license_scans": licenses.scan, "op8_quality_rules": quality.judge}[name](docs).drop("text", "cleaned", "n_lines_removed")
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    same(got, db.execute(queries.ORACLE[name]))


def same(got, want):
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    b = sorted(repr([plain(v) for v in r]) for r in want.fetchall())
    assert a == b
