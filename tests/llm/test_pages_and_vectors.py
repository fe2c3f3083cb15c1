"""WARC round trip, HTML text, exact top-k and the pipeline."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spanweave.llm import common, html_text, topk, warc
from spanweave.llm.html_text import visible_text
from tests.llm.data import EDGE_SCHEMA, edge_rows


def test_warc_round_trip_with_hostile_payloads(spark):
    body = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc é😀"
    rows = [(5, "http://a/5", body), (3, "http://a/3", body), (9, None, body), (None, "u\r\nX: y", body), (4, "http://a/4", ""),
            (6, "http://a/6", None), (7, "u", "short"), (8, "u", "short"), (10, "u", "y" * 150), (10, "u", "y" * 150), (11, "u", "y" * 150)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = common.shared_path(spark, "test-warc")
    warc.write_archives(df, path)
    got = warc.read_captures(spark, path).select(
        warc.page_ids(F.col("metadata.about_page"), "bigint").alias("page"), "answer.kind", "answer.payload",
        warc.page_ids(F.col("metadata.about_refers"), "bigint").alias("refers"), "request.uri", "answer.payload_bytes")
    seen = sorted(((r["page"], r["kind"], r["refers"], r["payload_bytes"]) for r in got.collect()), key=str)
    n = len(body.encode())
    assert seen == sorted([(5, "revisit", 3, n), (3, "response", None, n), (9, "revisit", 3, n), (None, "revisit", 3, n),
                           (4, "response", None, 0), (6, "response", None, 0), (7, "response", None, 5), (8, "response", None, 5),
                           (10, "response", None, 150), (10, "response", None, 150), (11, "revisit", 10, 150)], key=str)
    assert {r["payload"] for r in got.where("page = 3").collect()} == {body}


def _foreign(n, kind="response"):
    """A record as crawlers write it, with payload bytes that hold the separators."""
    payload = b"\r\n\r\nWARC/1.0\r\n" + b"\xff" * n
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID:<urn:{kind}:{n}>\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n", payload


def test_warc_reads_members_and_plain_archives(spark, tmp_path):
    import gzip
    import hashlib
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    made = [_foreign(n) for n in (0, 1, 50, 70_000, 600_000)]
    whole = b"".join([info, *[r for r, _ in made]])
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in [info, *[r for r, _ in made]]))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "plain.warc").write_bytes(whole)
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(whole)[:-500])
    (tmp_path / "empty.warc").write_bytes(b"")
    want = sorted((len(p), hashlib.sha256(p).hexdigest()) for _, p in made)
    for name, times in (("members.warc.gz", 1), ("one.warc.gz", 1), ("plain.warc", 1), ("empty.warc", 0)):
        got = warc.read_captures(spark, str(tmp_path / name)).select("answer.*").collect()
        assert sorted((r["payload_bytes"], r["payload_digest"]) for r in got) == want * times, name
    cut = warc.read_captures(spark, str(tmp_path / "cut.warc.gz")).count()
    assert cut < len(made)


def test_warc_reader_holds_one_record(tmp_path):
    """A 1 GB archive of many members within a small part of its size."""
    import gzip
    import tracemalloc
    member = gzip.compress(_foreign(1 << 20)[0])
    data = member * 1000
    tracemalloc.start()
    n = sum(len(block) for _, block in warc.records(warc.inflated(data)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1000 << 20 and peak < 32 << 20


def test_warc_empty_table(spark):
    path = common.shared_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_captures(spark, path).count() == 0


@pytest.mark.parametrize("html, text", [
    (None, None), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"), ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"), ("x<br>y", "x\ny"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("<script>if (a<b) x()</script>t<style>p{}</style>", "t"), ("<p hidden>n</p><p style='display: none'>n</p><p>y</p>", "y"),
    ("a < b <3 & c", "a < b <3 & c"), ("<b>x <i>y</b> z</i>", "x y z"), ("<!-- c --><h1>T</h1>x", "T\n\nx"),
    ("<title>t</title><body>b</body>", "b"), ("<div>" * 5000 + "deep", "deep"), ("<p>un<closed", "un<closed"),
])
def test_html_layout(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>T</title><p>Hello", "Hello"), ("<head><meta charset=x>\n<script>s</script> Hello <b>you</b>", "Hello you"),
    ("<head><title>T</title><noscript><p>n</p></noscript><template><p>t</p></template><div>a</div></head>b", "a\nb"),
    ("<head><style>p{}</style></head><body>b", "b"), ("<div><svg/>text</div>", "text"),
    ("<div><svg width=1 />text</div>", "text"), ("<svg><title/><g id='a'/></svg>text", "text"),
    ("<svg width=1/>hidden</svg>text", "text"),
    ("a<svg><title>t</title><desc>d</desc><style>s</style><g>x<text>b <tspan>c</tspan></text><text>d</text></g></svg>e", "a\nb c\nd\ne"),
    ("<p>n<textarea rows=2>one &amp;\n  <b>two</textarea>m", "n\none &\n  <b>two\nm"),
    ("<select><option>a<option hidden>h<option>b</select>c", "a\nb\nc"),
    ("<select><optgroup label='L'><option>a<optgroup label=M><option>b</select>", "L\na\nM\nb"), ("<div><svg><path d=x /></svg>text</div>", "text"),
])
def test_html_implied_ends(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>d</table>", "wide  c\na  b  d"),
    ("<table><tr><td rowspan=2>tall<td>b<tr><td>d<tr><td>e<td>f</table>", "tall  b\n      d\ne     f"),
    ("<table><tr><td>a<td><td>c<tr><td>d<td><td>f</table>", "a    c\nd    f"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
    ("<div style='display:none'>no<b style='visibility:visible'>no</b></div>yes", "yes"),
    ("<details><summary>head</summary>body</details>", "head"),
    ("<details open><summary>head</summary>body</details>", "head\nbody"),
    ("<p>one <b two</p>three", "one\n\nthree"), ("a <b", "a <b"), ("a <? b", "a"), ("<svg><g/>", ""),
])
def test_html_spans_and_visibility(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("part", [
    "<div>", "<a ", "<span>", "<p><table>", "<ul><li>x", "<table><tr><td>x", "<a<", "<!", "<a \"", "<a '\"", "<b></i>",
    "<svg a=====\"/>", "<td rowspan=9>x", "<tr><td colspan=1000 rowspan=60000>x", "<select><option>x", "<pre>x\n", "<svg>",
])
def test_html_time_is_linear(part):
    import time
    n = 200_000
    for html in (part * n, "<span>" * (n // 2) + part * (n // 2) + "</div></p>" * (n // 2)):
        begun = time.process_time()
        text = visible_text(html)
        assert time.process_time() - begun < 12 and len(text) < 100 * len(html)


def test_html_tree_equals_a_plain_search():
    """The tree of random pages, against a builder that searches the open elements one by one."""
    import random

    def outline(node):
        return (node.tag, [c if isinstance(c, str) else outline(c) for c in node.children])

    def plain(parts):
        root = html_text.Node("#root")
        stack = [root]
        for kind, tag in parts:
            if kind == "text":
                stack[-1].children.append(tag)
            elif kind == "end":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in html_text.WALL and tag not in html_text.WALL and tag not in html_text.ROWS:
                        break
            else:
                gone, barrier = html_text.CLOSES.get(tag, ((), ()))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in barrier:
                        break
                    if stack[k].tag in gone:
                        del stack[k:]
                        if tag not in html_text.SEVERAL:
                            break
                node = html_text.Node(tag)
                stack[-1].children.append(node)
                stack.append(node)
        return root

    rng = random.Random(3)
    tags = "div p ul li table tr td th tbody span b dl dt dd select option button".split()
    form = {"text": "{}", "end": "</{}>", "start": "<{}>"}
    for _ in range(3000):
        parts, last = [], None
        for k in range(rng.randrange(1, 40)):
            kind = rng.choice(["start", "start", "end"] + ["text"] * (last != "text"))
            parts.append((kind, f"t{k}" if kind == "text" else rng.choice(tags)))
            last = kind
        html = "".join(form[kind].format(tag) for kind, tag in parts)
        assert outline(html_text.build(html)) == outline(plain(parts)), html


def test_html_keeps_columns(spark):
    df = spark.createDataFrame([(1, "<p>a", "x"), (2, None, "y")], "page_id int, html string, `_text` string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(df).collect()}
    assert got == {1: "a", 2: None}


def _brute(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if i % 50 == 0:
            cand = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(cand, 1)}
    return out


def test_topk_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "RING", 16)
    monkeypatch.setattr(topk, "SAMPLE", 60)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(600)]
    rows += [(i, rows[7][1]) for i in range(600, 800)]                     # many equal vectors: ties by id
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()}
    assert got == _brute(rows, 5)


def test_topk_small_tables(spark):
    kind = "vec_id bigint, embedding array<float>, q int, v string"
    two = spark.createDataFrame([(0, [1.0, 2.0], 1, ""), (1, [3.0], 1, "")], kind)
    assert [tuple(r) for r in topk.exact_topk(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 768)]
    assert topk.exact_topk(spark.createDataFrame([], kind), F.col("vec_id") % 50 == 0).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 150)}}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    have = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= have and len(ids) > 0.8 * len(have)
        if name != "packing":
            assert out.columns == docs.columns
        have, docs = ids, out


def test_pipeline_stages_on_edge_rows(spark, tmp_path):
    import corpus_pipeline
    docs = spark.createDataFrame(edge_rows(), EDGE_SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() > 0


def test_all_stages_keep_columns_of_clashing_names(spark):
    import corpus_pipeline
    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("rk"), F.lit("c").alias("c"), F.lit("r").alias("_rk"), F.lit(2).alias("id"))
    docs = good.unionByName(spark.createDataFrame(edge_rows(), EDGE_SCHEMA)).select(
        "*", F.lit("mine").alias("_lang_pred"), F.lit(-1.5).alias("_LANG_SCORE"), F.lit("s").alias("_spans"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, "/root/testdata/sf0.001"), "stage")
        rest = docs.select("_lang_pred", "_LANG_SCORE", "_spans", "rk", "c", "_rk", "id").distinct().collect()
        assert [tuple(r) for r in rest] == [("mine", -1.5, "s", 1, "c", "r", 2)], name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    held = {}
    for r in pieces:
        assert len(r["ids"]) == r["length"]
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(n for _, n in places) <= 1024


def test_all_stages_on_an_empty_table(spark):
    import corpus_pipeline
    docs = spark.createDataFrame([], EDGE_SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0, name
        docs = out if name != "packing" else docs
