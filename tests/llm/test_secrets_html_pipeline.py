"""Secret scans, main text of pages, and the pipeline."""

import hashlib
import random
import re

from frames import edge_docs, no_docs

from foliotab.llm import extraction, secrets

TOKEN = "aB3xQ9zL7mT2vK5wR8nP4cJ6dF1gH0yS2uE"
HEX40 = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def base_digest(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))
    return [sum(k == j for _, k, _ in out) for j in range(3)], hashlib.sha256(shown.encode()).hexdigest()


def secret_rows():
    live, copied = "hunter2-hunter2", "AKIA" + "ABCD1234EFGH5678"
    rows = [(1, f'é password = "{live}" end', "a"), (2, f"token='{HEX40}'", "a"), (3, "API_KEY:short", "b"), (4, "nothing here", "b"),
            (5, f"key {TOKEN} done", "a"), (None, f"passwd={HEX40}", None), (7, None, "c"), (8, "", "c"), (9, "secret: password=abcdefgh1", "c")]
    return rows + [(20 + i, f"see {copied} in the docs {copied}", f"owner{i}") for i in range(9)] + [(1, f'é password = "{live}" end', "a")]


def test_ownership_against_sets(spark):
    rng = random.Random(4)
    keys = [f"{rng.getrandbits(160):040x}" for _ in range(6)]
    rows = [(d, f"see {keys[k]} here", o) for k, (owners, docs) in enumerate([(1, 1), (2, 4), (3, 3), (1, 50), (1, 51), (2, 80)])
            for d, o in [(1000 * k + i, f"o{i % owners}") for i in range(docs)]]
    rows += rows[:5] + [(3000, rows[8][1], "o0")] * 3 + [(7000 + i, f"{keys[0]} again", "o0") for i in range(2)]
    held = {}
    for d, text, o in rows:
        held.setdefault(next(k for k in keys if k in text), set()).add((o, d))
    want = {k: len({o for o, _ in v}) <= secrets.MOST_LIVE_OWNERS and len(v) <= secrets.MOST_LIVE_REPOSITORIES for k, v in held.items()}
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, repository string")
    for r in secrets.report(docs).join(docs, "doc_id").collect():
        assert (r.n_live, r.n_copied) == ((1, 0) if want[next(k for k in keys if k in r.text)] else (0, 1))
    assert sorted(want.values()) == [False] * 3 + [True] * 3


def test_secret_report(spark):
    rows = secret_rows()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, source string, row int, spans string")
    got = sorted(secrets.report(df).collect(), key=str)
    want = sorted([(i, *base_digest(t)) for i, t, _ in rows], key=str)
    assert sorted([(r.doc_id, [r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in got], key=str) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[20].n_copied == 2 and by_id[20].n_live == 0 and by_id[2].n_live == 2
    assert by_id[5].spans == f"token:4:{4 + len(TOKEN)}" and by_id[4].spans == ""
    clean = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert clean[1] == 'é <secret>" end' and clean[2] == "<secret>'" and clean[4] == "nothing here" and clean[7] is None
    assert clean[20] == "see <example> in the docs <example>" and clean[5] == "key <secret> done"


def test_secret_documents_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: base_digest(r.text) for r in docs.collect()}
    assert {r.doc_id: ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) for r in secrets.report(docs).collect()} == want
    assert secrets.report(edge_docs(spark)).count() == edge_docs(spark).count()
    assert secrets.report(no_docs(spark)).collect() == [] == secrets.redacted(no_docs(spark)).collect()
    same = secrets.redacted(edge_docs(spark), length_col="n_chars")
    assert same.columns == edge_docs(spark).columns
    assert sorted(str(r.text) for r in same.collect()) == sorted(str(r.text) for r in edge_docs(spark).collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="top"><a href="/">Home</a></header>
<div class="cookie-notice">We use cookies to make this site better for you and for everyone else who visits.</div>
<aside><p>A sidebar with a lot of text that has nothing to do with the article at all, honestly.</p></aside>%s
<section id="comments"><p>Great read, thank you for this long and careful article about rivers and mills!</p></section>
<form><p>Subscribe to our weekly letter with all the news about rivers and mills today</p></form><footer>&copy; us</footer></body></html>"""
BODY = "<h1>Rivers &amp; mills</h1><p>The old river runs past\n the <b>quiet</b>&nbsp;mill and over the weir into the valley below.<p>Short.</p><div class=ad>Buy now</div><p>Again the water turns the wheel as it did when the mill was built long ago.</p>"
TEXT = "Rivers & mills\n\nThe old river runs past the quiet mill and over the weir into the valley below.\n\nShort.\n\nAgain the water turns the wheel as it did when the mill was built long ago."


def test_main_text():
    assert extraction.main_text(PAGE % f"<article>{BODY}</article>") == TEXT
    assert extraction.main_text(PAGE % f"<div class='post'>{BODY}</div>") == TEXT
    assert extraction.main_text((PAGE % f"<div class='post'>{BODY}</div>").replace("<div class='post'>", "<ul><li><a href=x>One</a><li><a href=y>Two</a></ul><div>")) == TEXT
    assert extraction.main_text("<article>" + BODY[:-4] + "<p") == TEXT
    assert extraction.main_text("") == "" and extraction.main_text("<script>x</script>") == ""
    assert extraction.main_text("plain") == "plain"


def test_pages(spark, sf):
    import html

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 1), (2, "u", "", 1), (None, "v", "<p>" + "long text " * 20_000, 1)],
                                "page_id long, url string, html string, text int")
    rows = sorted((r.page_id or 0, r.n_chars) for r in extraction.extract(odd).collect())
    assert rows == [(0, 199_999), (1, 0), (2, 0), (2, 0)]
    assert extraction.extract(odd.limit(0)).collect() == []


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from foliotab.llm import language
    from foliotab.llm.shared import stored
    from test_copies import brute_force
    from test_layout import windows_of

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf), lasting=True)
        rows = after.collect()
        if name == "language":
            assert {r.doc_id for r in rows} == {r.doc_id for r in language.predict(docs, language.train(docs)).collect() if r.accepted}
        if name == "near_copies":
            assert sorted(r.doc_id for r in rows) == sorted({c for _, c in brute_force(before.items()).values()})
        if name == "secrets":
            assert {r.doc_id for r in rows} == set(before)
            assert all(base_digest(r.text)[0] == [0, 0, 0] and r.n_chars == len(r.text) for r in rows)
        if name == "mixing":
            assert {(r.doc_id, r.text) for r in rows} <= set(before.items())
        if name == "packing":
            assert sum(r.start == 0 for r in rows) == docs.count()
            windows_of(rows)
        else:
            assert after.columns == columns
        docs, before = after, {r.doc_id: r.text for r in rows} if name != "packing" else {}
    assert corpus_pipeline.run(spark, sf).count() == len(rows)
