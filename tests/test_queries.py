"""Every query of the library against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from corpusforge.plans import curation, evaluation  # noqa: F401  both register queries
from corpusforge.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = canonical(df.select(*columns).collect())
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        rel = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in rel.description]
        assert sorted(names) == columns
        want = [[r[names.index(c)] for c in columns] for r in rel.fetchall()]
        assert got == canonical(want)
    else:
        assert name in {"build_near", "near_dup_groups"}  # against brute force in test_curation and test_evaluation
        assert got and columns == {"build_near": ["ord", "question_md5", "source_id"], "near_dup_groups": ["confidence", "group_id", "keep", "size"]}[name]
