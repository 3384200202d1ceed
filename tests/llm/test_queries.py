"""The registered queries themselves: against their SQL where there is one, else against brute force, on the smallest tables."""

import zlib
from html.parser import HTMLParser
from pathlib import Path

import pytest

from millrace.llm import htmltext, quality, queries, urlfilter
from millrace.session import release_staged

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    found = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        found.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, db, name):
    got = queries.QUERIES[name](spark, str(DATA))
    want = db.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(repr([norm(v) for v in r]) for r in got.collect()) == sorted(repr([norm(r[k]) for k in at]) for r in want.fetchall())
    release_staged()


def test_op1(spark, db):
    """Scores are those of the model fitted apart from Spark, held_out is the remainder's, and labels decide held-out accuracy."""
    got = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, str(DATA)).collect()}
    texts = dict(db.sql("select doc_id, text from documents").fetchall())
    labels = dict(db.sql("select doc_id, quality from labels").fetchall())
    assert set(got) == set(texts) and all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    model = quality.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    for k, t in texts.items():
        assert got[k]["score"] == pytest.approx(float(model.scores(*quality.line_features([t or ""]))[0]), abs=1e-9) and got[k]["predicted"] == (got[k]["score"] >= 0.5)
    held = [k for k in labels if got[k]["held_out"]]
    assert sum(got[k]["predicted"] == labels[k] for k in held) >= 0.95 * len(held)


def test_op2(spark, db):
    """Verdicts are those of the rules, else of the model's weights applied one url at a time."""
    w, b = urlfilter.train(urlfilter.LABELLED_URLS)
    for r, (url,) in zip(queries.op2_url_filters(spark, str(DATA)).orderBy("page_id").collect(), db.sql("select url from pages order by page_id").fetchall(), strict=True):
        rest = url.partition("://")[2] if url and "://" in url else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut : min((rest.find(c, cut) for c in "?#" if c in rest[cut:]), default=len(rest))]
        fits = [(len(h + p), h + p, verdict) for verdict, h, p in queries.URL_RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        found = urlfilter.grams(host, path)
        score = sum(w[k] for k in found) / max(1, len(found)) ** 0.5 + b
        want = max(fits)[1:] if fits else (None, "block" if score >= 0 else "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *want)


class Article(HTMLParser):
    """Blocks of the article element, read with Python's own parser: what the tables' pages mark as their text."""

    BLOCKS = frozenset("article p h1 br li ul".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.muted, self.blocks = False, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.muted += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.muted -= tag in ("script", "style")
        if tag in self.BLOCKS:
            self.blocks.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside and not self.muted:
            self.blocks[-1] += data


def test_op8(spark, db, monkeypatch):
    got = {r["page_id"]: r for r in queries.op8_html_extraction(spark, str(DATA)).collect()}
    pages = db.sql("select page_id, url, html from pages").fetchall()
    for page, url, html in pages:
        reader = Article()
        reader.feed(html)
        reader.close()
        text = "\n".join(x for x in (" ".join(b.split()) for b in reader.blocks) if x)
        assert (got[page]["url"], got[page]["text"], got[page]["n_chars"]) == (url, text, len(text)) and text
    # without the scan every page comes out otherwise
    weights = htmltext.learn_weights(htmltext.LABELLED_PAGES)
    monkeypatch.setattr(htmltext, "best_region", lambda found, weights: (0, len(found)))
    assert all(htmltext.main_text(html, weights) != got[page]["text"] for page, _, html in pages)
