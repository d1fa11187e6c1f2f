import numpy as np

from slotline.llm import langid as li
from slotline.llm.common import hashed_share
from tests.conftest import TESTDATA


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    model = li.fit(docs.filter("doc_id % 4 <> 2"))
    test = docs.filter("doc_id % 4 = 2")
    got = {r.id: r for r in li.fuse(li.document_rows(test), model).collect()}
    want = {r.doc_id: r.lang for r in test.collect()}
    assert len(got) == len(want) and np.mean([got[i].lang == y for i, y in want.items()]) >= 0.97
    assert not any(r.rejected for r in got.values())


def test_evidence_decides_where_the_text_cannot(spark):
    model = li.train([b"the cat and the dog " * 5, b"der hund und die katze " * 5], ["en", "de"])
    rows = [(k, "the cat and the dog", "en", "uk", "site", "a.site") for k in range(30)] + [(100 + k, "der hund und die katze", "de", "de", "other", "b.other") for k in range(30)]
    rows += [(1000, "a", "de", "de", "other", "b.other"), (1001, "a", "en", "uk", "site", "a.site"), (1002, "a", None, None, "site", "new.site"), (1003, "***", "en", "uk", "site", "a.site"), (1004, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, suffix string, site string, host string")
    got = {r.id: r.lang for r in li.fuse(df, model).collect()}
    assert got[1000] == "de" and got[1001] == got[1002] == "en" and got[1003] == got[1004] == "und"
    assert all(got[k] == "en" for k in range(30)) and all(got[100 + k] == "de" for k in range(30))


def test_page_rows(spark):
    page = '<!DOCTYPE html><HTML class="x" lang="de-AT"><head><style>p{m}</style></head><body>Hallo &amp; <b>Welt</b></body></HTML>'
    df = spark.createDataFrame([(1, "http://www.Example.de/en/x", page), (2, None, None), (3, "x", "<p>")], "page_id long, url string, html string")
    got = {r.id: r for r in li.page_rows(df).collect()}
    assert (got[1].declared, got[1].suffix, got[1].site, got[1].host) == ("de", "de", "example.de", "www.example.de")
    assert got[1].text.split() == ["Hallo", "Welt"] and got[2].declared is None and got[3].host is None


def brute(rows, seen, names):
    """Fusion by plain loops: `rows` are (id, declared, suffix, site, host), `seen` the texts' log likelihoods by id."""
    n, post = len(names), {}
    for i, logs in seen.items():
        e = np.exp(np.array(logs) - max(logs))
        post[i] = e / e.sum()
    out = {}
    for i, declared, suffix, _, host in rows:
        others = [r for r in rows if r[0] != i]
        total = sum((post[r[0]] for r in others), np.zeros(n))
        prior = (total + 1) / (len(others) + n)
        site_of = {h: min((r[3] for r in rows if r[4] == h and r[3]), default=None) for h in {r[4] for r in rows if r[4]}}
        if host and site_of[host]:
            own = [post[r[0]] for r in others if r[4] and site_of[r[4]] == site_of[host]]
            prior = (sum(own, np.zeros(n)) + li.PRIOR_ROWS * prior) / (len(own) + li.PRIOR_ROWS)
        if host:
            own = [post[r[0]] for r in others if r[4] == host]
            prior = (sum(own, np.zeros(n)) + li.PRIOR_ROWS * prior) / (len(own) + li.PRIOR_ROWS)
        logs = np.array(seen[i]) + np.log(prior)
        for value, column in ((declared, 1), (suffix, 2)):
            if value:
                logs += np.log((sum((post[r[0]] for r in others if r[column] == value), np.zeros(n)) + 0.5) / (total + 50))
        e = np.exp(logs - logs.max())
        out[i] = (names[int(e.argmax())], float(e.max() / e.sum()))
    return out


def equals_brute(rows, model):
    got = {r.id: r for r in li.fuse(rows, model).collect()}
    own = [(r.id, r.declared, r.suffix, r.site, r.host) for r in rows.collect()]
    seen = {r.id: r.seen for r in li.text_evidence(rows, model).collect()}
    want = brute(own, seen, [*model.languages, li.UND])
    assert got.keys() == want.keys()
    for i, (lang, confidence) in want.items():
        assert got[i].lang == lang and abs(got[i].confidence - confidence) < 1e-4 and got[i].rejected == (lang == li.UND)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").limit(120)
    equals_brute(li.document_rows(docs).cache(), li.fit(docs, train_docs=40))


def test_pages_equal_brute_force(spark):
    docs, pages = (spark.read.parquet(f"{TESTDATA}/sf0.001/{t}.parquet") for t in ("documents", "pages"))
    equals_brute(li.page_rows(pages.limit(150)).cache(), li.fit(docs, train_docs=40))


def test_languages_of_pages(spark):
    """Pages made of documents, whose language is known but declared for a half only, and wrongly for some."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").filter("length(text) > 40")
    model = li.fit(docs.filter("doc_id % 4 <> 2"))
    said = "case when doc_id % 20 = 2 then 'fr' when doc_id % 8 = 2 then lang end"
    pages = docs.filter("doc_id % 4 = 2").selectExpr("doc_id as page_id", f"concat('<html', coalesce(concat(' lang=\"', {said}, '\"'), ''), '><p>', text, '</p></html>') as html", "concat('http://', lang, doc_id % 3, '.example.org/x') as url", "lang")
    got = {r.id: r.lang for r in li.fuse(li.page_rows(pages), model).collect()}
    assert np.mean([got[r.page_id] == r.lang for r in pages.collect()]) >= 0.97


def test_odd_pages(spark, odd_docs):
    model = li.fit(spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet"))
    rows = [(1, None, None), (None, "http://a.de/", "<html lang=de>Hallo Welt"), (2, "", ""), (3, "http://b.fr/x", "<p>" + "bonjour le monde " * 20_000), (3, "http://b.fr/x", "<p>bonjour"), (3, "http://b.fr/x", "<p>bonjour")]
    pages = spark.createDataFrame([(*r, 7, "x", 1.0) for r in rows], "page_id long, url string, html string, host int, seen string, post double")
    got = li.fuse(li.page_rows(pages), model).collect()
    assert len(got) == len(rows) and sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(r.rejected for r in got if r.id in (1, 2))
    assert li.fuse(li.page_rows(pages.limit(0)), model).count() == 0 and li.fuse(li.page_rows(pages), li.train([], [])).count() == len(rows)


def test_texts_of_no_known_language_go(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    rng = np.random.default_rng(0)
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. "
    strange = [(-1, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 600))), (-2, "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 4), (-3, finnish * 2)]
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in strange], docs.schema)
    kept = {r.doc_id for r in li.accepted(docs.unionByName(more)).select("doc_id").collect()}
    numbers = "Thedha ingoust erther 16.76.88.133 in the, 4160062719256784 lyndti the enhere. on +1 (428) 555-6997 token = '1d46e940c38b6b02bbe8d98b2da087fb424daede'"
    assert li.accepted(docs.limit(0).unionByName(spark.createDataFrame([(-4, numbers, "en", "s", 1)], docs.schema)).unionByName(docs)).filter("doc_id = -4").count() == 1
    assert not kept & {-1, -2, -3} and kept == {r.doc_id for r in docs.filter(r"text rlike '\\p{L}'").select("doc_id").collect()}


def test_rows_of_one_id_go_by_their_own_text(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").filter("length(text) > 100")
    text = docs.first().text
    more = [(7_000_000, text, "en", "a"), (7_000_000, "123", "en", "a"), (None, text, None, None), (None, None, None, None), (None, "?", None, "b")]
    kept = li.accepted(docs.unionByName(spark.createDataFrame(more, docs.schema))).filter("doc_id = 7000000 or doc_id is null").collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(7_000_000, text)] and [r.text for r in kept if r.doc_id is None] == [text]


def test_sample_has_rows_with_and_without_ids(spark):
    docs = spark.range(20_000).selectExpr("if(id % 2 = 0, null, id) as doc_id", "concat('text ', id) as text")
    got = hashed_share(docs, 1000, "doc_id", "text").toPandas()["doc_id"].isna()
    assert 850 < len(got) < 1150 and 0.4 < got.mean() < 0.6


def test_odd_rows(odd_docs, no_docs):
    got = li.identify(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r.lang == "und" and r.rejected for r in got if r.doc_id in (3, 4, 5))
    kept = li.accepted(odd_docs)
    assert kept.columns == odd_docs.columns and {1, 2, 6, 7, 8} <= {r.doc_id for r in kept.collect()}
    assert li.identify(no_docs).count() == 0 and li.accepted(no_docs).count() == 0
