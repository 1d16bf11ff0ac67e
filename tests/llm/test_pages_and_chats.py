"""Pages, archives, dialogues and shards against brute force."""

import base64
import hashlib
import html as entities
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sievelog.llm import html, perspectives, sharding, warc
from sievelog.llm.common import scratch_path
from sievelog.llm.queries import OP5_SQL, op8_sql


@pytest.fixture(scope="module")
def pages(spark, sf):
    given = spark.read.parquet(f"{sf}/pages.parquet")
    more = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "u", ""), (10**6 + 2, "u\r\nx", "twin \x1f\x8b\x08"), (10**6 + 3, "u", "twin \x1f\x8b\x08"), (10**6 + 3, "u", "twin \x1f\x8b\x08"), (10**6 + 4, "u", "é" * 900_000), (None, "u", "none")], "page_id long, url string, html string")
    return given.unionByName(more)


def test_round_trip(pages):
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last = {}
    for i, p in rows:
        if i is not None:
            last[p] = max(last.get(p, i), i)
    want = []
    for i, p in rows:
        target = last.get(p)
        other = target is not None and target != i
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if other else "response", target if other else None))
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("split", [700, 5000, 1 << 22])
def test_splits_own_each_record_once(spark, pages, split):
    part = pages.where("page_id < 40 or page_id >= 1000000")
    manifest = warc.write_archives(warc.deduplicated(part.coalesce(1)), scratch_path(spark, "warc"))
    got = warc.read_archives(spark, manifest, split)
    assert sorted(str(r.page_id) for r in got.collect()) == sorted(str(r.page_id) for r in part.collect())
    payloads = {r.page_id: bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert all(payloads[r.page_id] == (r.html or "").encode() for r in part.collect() if r.page_id in payloads)


def test_long_urls_and_lost_records(spark):
    long = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000))
    given = spark.createDataFrame([(1, "u", "a"), (2, "data:" + "x" * 70_000, "b"), (3, long, "c"), (4, "v", "d")], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.deduplicated(given.coalesce(1)), scratch_path(spark, "warc"))
    for split in (1000, 1 << 22):
        got = warc.read_archives(spark, manifest, split)
        assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got.collect()) == sorted(map(tuple, given.collect()))
    more = manifest.withColumn("starts", F.concat("starts", F.array(F.lit(1).cast("long"))))
    with pytest.raises(Exception, match="records read of"):
        warc.read_archives(spark, more).collect()


def test_splits_are_dealt_to_tasks(spark, pages):
    manifest = warc.write_archives(warc.deduplicated(pages.coalesce(1)), scratch_path(spark, "warc"))
    splits = -(-manifest.first().size // 4000)
    got = warc.read_archives(spark, manifest, 4000)
    assert splits > 8 and got.rdd.getNumPartitions() == min(splits, 8 * spark.sparkContext.defaultParallelism)
    assert got.count() == pages.count()


def test_archives_of_empty_tables_and_clashing_columns(spark):
    columns = "page_id long, url string, html string, name string, n int, target long, refers_to long, record_type string, path string"
    row = (1, "u", "a", "x", 7, 8, 9, "resource", "p")
    given = spark.createDataFrame([row, (2, None, "a", *row[3:]), (None, "u", None, *row[3:])], columns)
    got = warc.round_trip(given).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1, "revisit", 2), (2, 1, "response", None), (None, 0, "response", None)]
    assert warc.round_trip(given.limit(0)).count() == 0


def expected(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?p>|</?h1>|<br>", body)]
    return "\n".join(x for x in parts if x)


def test_main_text(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html.extract(given).collect()}
    wrong = [r.page_id for r in given.collect() if got[r.page_id].text != expected(r.html)]
    assert len(got) == given.count() and not wrong
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_main_text_of_other_templates(spark, sf):
    given = spark.read.parquet(f"{sf}/pages.parquet")
    model = html.fit(given)
    text = "The thing inand shed of errethe thand onesth, and the reand ou therha with blending thion. " * 3
    page = f"""<html><head><title>t</title><script>if (a<b) x("<p>no</p>")</script></head><body>
    <header class="masthead"><div>Site name</div></header><nav><ul><li><a href="/">Home</a><li><a href="/x">More</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies here.</p><button>ok</button></div>
    <article><h1>Head &amp; line</h1><p>{text}<p>Second   &eacute; {text}</p><ul><li>{text}</li></ul><form><label>mail</label><input></form></article>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/a">one link</a></li></ul></aside>
    <div id="comments"><div class="comment"><p>Nice words, thanks a lot for them.</p></div></div><footer>&copy; 2024</footer></body></html>"""
    clean = text.strip()
    assert html.main_text(page, model) == f"Head & line\n{clean}\nSecond é {clean}\n{clean}"


def test_text_directly_in_the_body(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html.fit(given)
    assert html.main_text("<body><nav>Home</nav>Article text<br><br>more</body>", model) == "Article text more"
    assert html.main_text("<h1>T</h1>text<p>para</p>text", model) == "T\ntext\npara\ntext"
    assert html.main_text("only &amp; text", model) == "only & text"
    wrong = 0
    for r in given.collect():
        bare = re.sub(r"<article>(.*?)</article>", lambda m: re.sub(r"</?p>", "<br>", m[1]), r.html, flags=re.S)
        wrong += html.main_text(bare, model).split() != expected(r.html).split()
    assert wrong == 0
    # a few words beside an article are judged, and not taken
    assert html.main_text("Skip to content<article><h1>T</h1><p>Text of it.</p></article>", model) == "T\nText of it."


PROSE = ["The thing inand shed of errethe thand onesth, and the reand ou therha with blending thion. " * n for n in (2, 3, 4)]
A, B, C = (p.strip() for p in PROSE)
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "News", "Sport", "About us"))
LAYOUTS = {
    "plain blocks": (f"<body><div><p>{A}</p><p>{B}</p></div></body>", [A, B]),
    "blocks beside a menu": (f"<body><div><ul>{MENU}</ul></div><div><h1>Head line of it</h1><p>{A}</p><p>{B}</p></div><div>&copy; 2024 <a href='/i'>imprint</a></div></body>", ["Head line of it", A, B]),
    "table": (f"<body><table><tr><td><ul>{MENU}</ul></td><td><p>{A}</p><p>{B}</p></td></tr></table></body>", [A, B]),
    "bare body": (f"<body>{A}<br><br>{B}<p>{C}</p></body>", [f"{A} {B}", C]),
    "list": (f"<body><nav><ul>{MENU}</ul></nav><article><ul><li>{A}</li><li>{B}</li></ul></article></body>", [A, B]),
    "named block": (f'<body><ul class="menu">{MENU}</ul><div class="post-content"><p>{A}</p><blockquote>{B}</blockquote></div></body>', [A, B]),
    "nested comments": (f'<body><article><p>{A}</p><p>{B}</p></article><section class="comments"><article class="comment"><p>{C}</p><article class="comment reply"><p>{A}</p></article></article></section></body>', [A, B]),
    "aside inside": (f'<body><main><p>{A}</p><aside><p>See also this</p></aside><p>{B}</p></main><footer>{A[:60]}</footer></body>', [A, B]),
    "unclosed": (f"<body><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav><article><p>{A}<p>{B}</article>", [A, B]),
    "formula": (f"<body><article><p>{A} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {B}</p></article></body>", [f"{A} x=2 {B}"]),
}


@pytest.fixture(scope="module")
def model(spark):
    return html.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(model, name):
    source, want = LAYOUTS[name]
    assert html.main_text(source, model).split("\n") == want


def test_pages_in_proportion(model):
    import time

    began = time.process_time()
    many = "".join(f"<p>{i} {A}</p>" for i in range(20_000))
    assert html.main_text(f"<body><nav><ul>{MENU}</ul></nav><article>{many}</article></body>", model).count("\n") == 19_999
    assert time.process_time() - began < 8
    began = time.process_time()
    for bad in ("<a " * 330_000, '<a "' * 250_000, "<a '>" * 200_001, '<a "><b" ' * 100_000 + "'", "<li>" * 250_000, "<div>" * 200_000 + "x", "<option>" * 100_000, "<script>" * 100_000, "</x>" * 250_000, "<!--" * 250_000, "<!" * 400_000):
        html.main_text(bad, model)
    assert time.process_time() - began < 60
    deep = "<div>" * 3000 + A + "</div>" * 3000 + f"<p>{B}</p>"
    assert sorted(p for x in html.nodes(html.parse(deep)) for p in x.parts if isinstance(p, str)) == sorted([A, B])


def test_only_long_pages_and_clashing_columns(spark, monkeypatch):
    """Without pages under the bound the model is still fitted on the table's own."""
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    monkeypatch.setattr(html, "TRAIN_CHARS", 10)
    made = html.extract(given.selectExpr("*", "1 AS text", "2 AS h", "3 AS rank")).collect()
    assert [r.page_id for r in made if r.text != expected(next(x.html for x in given.collect() if x.page_id == r.page_id))] == []


def test_unclosed_options_end():
    def seen(source):
        return sorted(p.strip() for x in html.nodes(html.parse(source)) for p in x.parts if isinstance(p, str) and p.strip())

    assert seen("<datalist><option value=a>x<option>y</datalist><p>text</p>") == ["text"]
    assert seen("<datalist><option>x</option><option>y</datalist><p>one</p><select><option>z</select>two") == ["one", "two"]
    assert seen("<div><option>x</div><p>text</p>") == ["text"]
    assert seen("<p>a</p><option>x <b>y</b>") == ["a"]


def test_page_edges(pages):
    rows = html.extract(pages).collect()
    assert len(rows) == pages.count()
    assert all(r.text == "" and r.n_chars == 0 for r in rows if r.page_id in (10**6, 10**6 + 1))
    assert html.extract(pages.limit(0)).count() == 0


def test_decoding_is_consistent():
    found = html.nodes(html.parse("<div><p>a</p><div><p>b</p></div></div><nav><ul><li>c</li></ul></nav>"))
    import numpy as np

    kept = html.decode(found, np.random.default_rng(0).random(len(found)))
    place = {id(x): i for i, x in enumerate(found)}
    assert all(kept[place[id(x.parent)]] for i, x in enumerate(found) if kept[i] and x.parent)


def chats(spark, sf):
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    more = spark.createDataFrame([(9001, 0, "alice", "hi"), (9001, 1, "bob", None), (9001, 2, None, "x"), (9001, None, "carol", "late"), (9001, 70, "alice", "é\U0001f600"), (9001, 70, "alice", "é\U0001f600"), (9002, 0, "system", "only"), (None, 0, "user", "n")], "conv_id long, turn long, role string, text string")
    return given.unionByName(more)


def test_rotation_matches_sql(spark, sf):
    turns = chats(spark, sf)
    got = perspectives.rotate(turns)
    con = duckdb.connect()
    conversations = turns.toPandas()  # noqa: F841
    conversations["turn"] = conversations["turn"].astype("Int64")
    conversations["conv_id"] = conversations["conv_id"].astype("Int64")
    con.register("conversations", conversations)
    want = con.execute(OP5_SQL).fetchall()
    names = [d[0] for d in con.description]
    assert names == got.columns
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_masks_cover_the_assistant(spark, sf):
    for row in perspectives.dialogues(perspectives.rotate(chats(spark, sf).where("conv_id = 9001"))).collect():
        trained = [row.text[m.begin : m.end] for m in row.masks]
        said = {"alice": ["hi", "é\U0001f600", "é\U0001f600"], "bob": [""], "unknown": ["x"], "carol": ["late"]}[row.perspective]
        assert trained == [x + "<|im_end|>" for x in said]
        assert row.text.count("<|im_start|>assistant\n") == len(said)


def test_lookup_table():
    names = sharding.shard_names(16)
    table = sharding.lookup_table(names, 1009)
    # brute force: every shard's order written out, turns taken until all slots are claimed
    orders = [[(sharding._number(f"offset:{n}") % 1009 + j * (sharding._number(f"skip:{n}") % 1008 + 1)) % 1009 for j in range(1009)] for n in names]
    owner, i = {}, 0
    while len(owner) < 1009:
        slot = next(s for s in orders[i % 16] if s not in owner)
        owner[slot] = i % 16
        i += 1
    assert table == [owner[s] for s in range(1009)]
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 15)
    assert moved < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])


def test_placement(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    docs = docs.unionByName(spark.createDataFrame([(None,), (3,)], "doc_id long"))
    got = Counter(map(tuple, sharding.place(docs, "doc_id").select("doc_id", "slot", "shard").collect()))
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    assert got == Counter(con.execute(op8_sql()).fetchall())


def test_write_shards(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(docs, "doc_id", str(tmp_path / "out"), sharding.shard_names(4))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    by = defaultdict(set)
    for r in back.select("doc_id", "shard").collect():
        by[r.doc_id].add(r.shard)
    assert all(len(x) == 1 for x in by.values())
