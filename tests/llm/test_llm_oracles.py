"""Quality rules of a bad corpus, against the SQL that defines the query."""

import duckdb
import pandas as pd

from plumbline.llm import queries
from tests.llm.helpers import ODD
from tests.test_oracles import plain


def same_as_sql(spark, tmp_path, rows):
    pd.DataFrame(rows, columns=["doc_id", "text", "source"]).to_parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    df, want = queries.op10_quality_rules(spark, str(tmp_path)), duck.sql(queries.oracle_sql()["op10_quality_rules"])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    return [dict(zip(cols, r)) for r in got]


def test_a_bad_corpus_equals_sql(spark, tmp_path):
    """Most of these documents fail; hosts without evidence stay, in SQL too."""
    got = same_as_sql(spark, tmp_path, [(r[0], r[1], r[3]) for r in ODD if r[0] not in (None, 6, 7)])
    assert sum(r["kept"] == "True" for r in got) == 3


def test_rejected_hosts_equal_sql(spark, tmp_path):
    """Hosts of many failures lose their good documents too; small and good ones don't."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{good} g{i}", f"fine{i % 7}") for i in range(400)] + [(1000 + i, "short", "fine1") for i in range(5)]
    rows += [(2000 + i, "short" if i % 9 else f"{good} b{i}", "bad") for i in range(80)] + [(3000 + i, " ".join(f"#{k} ${k} %{k}" for k in range(9)) + f" {i}", "signs") for i in range(50)]
    rows += [(4000, "short", "new"), (4001, good, "new"), (5000, "short", None), (5001, None, None)]
    got = same_as_sql(spark, tmp_path, rows)
    lost = {int(r["doc_id"]) for r in got if r["base_failed"] == "False" and r["kept"] == "False"}
    assert lost == {i for i, t, s in rows if s in ("bad", "signs") and t != "short" and len(t.split()) >= 10}
