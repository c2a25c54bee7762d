"""Every registered query of the library against its SQL, over small tables."""

import datetime as dt
import os
import random

import duckdb
import pandas as pd
import pytest

from lodestone import registry

WORDS = "river stone walking walked quickly happiness nation Berlin Paris the of running engines engine database décision état größe".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of small tables of the shapes the queries read, with ties, nulls in texts' neighbours and copies."""
    r, path = random.Random(7), str(tmp_path_factory.mktemp("sf"))
    day = lambda a, n: dt.datetime(a, 1, 1) + dt.timedelta(days=r.randrange(n))
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    docs = [(i, say(r.randint(1, 120)) + "\nA line that repeats itself here\n" + say(5), r.choice(["en", "fr"]), f"src{i % 5}", r.randint(5, 900)) for i in range(60)]
    docs += [(100 + i, docs[0][1], "en", "src1", 50) for i in range(3)] + [(200, "", "en", "src2", 0)]
    lines = [(o, r.randrange(40), r.randrange(6), n, float(r.randint(1, 50)), 10.0, 0.1, 0.0, r.choice("ANR"), "O", day(1996, 900)) for o in range(120) for n in range(r.randint(1, 5))]
    data = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": ([(i, say(12)) for i in range(6)], "item_id long, text string"),
        "embeddings": ([(i, [r.gauss(0, 1) for _ in range(8)], i % 3) for i in range(60)], "vec_id long, embedding array<float>, label int"),
        "conversations": ([(c, t, "user" if t % 2 == 0 else "assistant", say(r.randint(2, 9))) for c in range(12) for t in range(6)], "conv_id long, turn long, role string, text string"),
        "events": ([(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(30 * 86400)), r.randrange(9), r.choice(["view", "signup", "purchase", "error", "click"]), round(r.random() * 99, 2), '{"k": %d}' % r.randrange(7)) for i in range(600)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        "pages": ([(i, f"https://host{i % 3}.example/p{i}", f"<html><title>Page {i}</title><body><a href='x'>go</a> <p>{say(9)}</p></body></html>") for i in range(9)], "page_id long, url string, html string"),
        "orders": ([(i, r.randrange(30), r.choice("FOP"), round(r.random() * 1e4, 2), day(1995, 2300), r.choice(["1-URGENT", "2-HIGH", "5-LOW"])) for i in range(400)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "customer": ([(i, f"Customer {i}", i % 5, round(r.random() * 9e3 - 999, 2), "X") for i in range(35)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(i, say(3), "Brand#1", "STANDARD TIN", r.randint(1, 4), 1.0) for i in range(45)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "supplier": ([(i, f"S{i}", i % 5, 1.0) for i in range(6)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": ([(i, f"N{i}", i % 2) for i in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "A"), (1, "B")], "r_regionkey int, r_name string"),
        "labels": ([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int"),
    }
    for name, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


def values(frame):
    """Rows as sorted tuples, columns by name."""
    def cell(v):
        if pd.isna(v):
            return "null"
        return repr(float(round(v, 9))) if isinstance(v, (int, float)) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) >= 45


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, tables, name):
    con = duckdb.connect()
    for t in os.listdir(tables):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tables}/{t}/*.parquet')")
    assert values(registry.queries()[name](spark, tables).toPandas()) == values(con.sql(registry.oracle_sql()[name]).df())
