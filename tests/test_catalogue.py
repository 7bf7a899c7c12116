"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import pytest

from sievewright.functions import markup
from sievewright.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    try:
        f = float(v) if not isinstance(v, str) else None
    except (TypeError, ValueError):
        f = None
    return v if f is None else round(f, 6) if math.isfinite(f) else None


def rows(df):
    names = sorted(df.columns)
    return sorted(str([plain(v) for v in r]) for r in df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, name):
    found = catalogue.queries()[name](spark, DATA).toPandas()
    assert len(found.columns)
    if sql := catalogue.oracle_sql().get(name):
        import duckdb

        db = duckdb.connect()
        for t in os.listdir(DATA):
            db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
        want = db.execute(sql).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)


def odd(folder, table, schema, values):
    """A folder with one table of ``values``."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*values), schema.values(), strict=True)], names=list(schema)), folder / f"{table}.parquet")
    return str(folder)


def both(spark, folder, name):
    """Rows of a query and of its SQL."""
    import duckdb

    db = duckdb.connect()
    for t in os.listdir(folder):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}'")
    return rows(catalogue.queries()[name](spark, folder).toPandas()), rows(db.execute(catalogue.oracle_sql()[name]).df())


TEXTS = [(0, "Some prose stands here.\nShort"), (1, ""), (2, None), (3, "\n"), (4, "x\n"), (5, " ")]


def test_lines_of_an_empty_text(spark, tmp_path):
    found, want = both(spark, odd(tmp_path, "documents", {"doc_id": "int64", "text": "string"}, TEXTS), "clean_lines")
    assert found == want and len(found) == 6


def test_documents_without_text_stay(spark, tmp_path):
    """An empty text is a row of its own, a null one has none."""
    found, want = both(spark, odd(tmp_path, "documents", {"doc_id": "int64", "text": "string"}, TEXTS), "clean_text")
    assert found == want and len(found) == 5


PAGE = """<!DOCTYPE html><html><head><title>{0}</title><style>p &quot {{}}</style><script>var a = "&quot";</script></head>
<body><a href="/a?b=1&c=2">one</a><a href="/x">two</a><a href="/y">three</a><p>{0} <b>and</b> &quot;more&quot; &amp; more {1}</p><footer><p>&copy; site &middot; {0}</p></footer></body></html>"""
CUT = ["token = &quot", "a &amp", "a &am", "a &", "&copy and &amp;", "&amp;quot", "&#39", "&quotes", "&amp;amp; R&D", "whole &quot;title&quot;", "x &middot", "&reg"]


def pages_cut(folder, repeat):
    """Pages whose titles are cut within an entity; each three times, as every third page holds its text in another way."""
    values = [(k, f"https://h.example/{k}", PAGE.format(CUT[k // 3], "word " * repeat)) for k in range(3 * len(CUT))]
    return odd(folder, "pages", {"page_id": "int64", "url": "string", "html": "string"}, values)


def test_title_cut_within_an_entity(spark, tmp_path):
    """The query leaves what its SQL leaves; the parser decodes entities that lack their semicolon."""
    found, want = both(spark, pages_cut(tmp_path, 5), "html_structure")
    assert found == want and len(found) == 36
    assert markup.outline("<title>a &quot</title>", None)["title"] == 'a "'


def test_recovery_of_text_cut_within_an_entity(spark, tmp_path):
    """Texts that are long enough, and reasons that tell the length of shorter ones."""
    for repeat in (5, 80):
        folder = tmp_path / str(repeat)
        folder.mkdir()
        found, want = both(spark, pages_cut(folder, repeat), "page_recovery")
        assert found == want and len(found) == 36
