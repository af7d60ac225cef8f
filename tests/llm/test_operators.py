"""The other operators on odd rows, against brute force, and the pipeline's stages."""

import base64
import gzip
import hashlib
import itertools
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rinse.llm import minhash, quality
from rinse.llm import queries as llm_queries
from rinse.llm.components import connected_components
from rinse.llm.decontaminate import contamination, decontaminate
from rinse.llm.merkle import changed_paragraphs, edited_fingerprints, leaves, leaves_of_paragraphs
from rinse.llm.minhash import deduplicate, near_duplicates
from rinse.llm.preferences import answer_turns, paired, preference_pairs, preference_turns
from rinse.llm.url_filter import judge, write_rules
from rinse.llm.warc import as_records, read_records, write_pages
from rinse.session import scratch

FOLDER = "/root/testdata/sf0.001"


def docs_frame(spark, docs):
    """Documents with columns whose names clash with those the operators use inside."""
    schema = "doc_id long, text string, key string, hash string, node int, root string, score string, words string"
    return spark.createDataFrame([(*doc, "k", None, 1, "r", "s", "w") for doc in docs], schema)


# URL filter

RULES = [("net", "/", "block"), ("a.net", "/en/", "allow"), ("a.net", "/en/", "allow"), ("b.a.net", "/en/", "block"),
         ("x.org", "/", "allow"), ("x.org", "/", "block"), (None, "/", "block"), ("ÄÖ.de", "/ß", "block")]
URLS = [
    (1, "http://A.NET/en/1", "a.net/en/", "allow"), (2, "http://c.b.a.net/en/", "b.a.net/en/", "block"),
    (3, "http://net/", "net/", "block"), (4, "http://xnet/", None, "allow"), (5, None, None, "allow"),
    (6, "no scheme.net/", None, "allow"), (7, "", None, "allow"), (8, "http://a.net", None, "allow"),
    (None, "http://x.org/" + "y" * 50_000, "x.org/", "block"), (1, "http://A.NET/en/1", "a.net/en/", "allow"),
    (9, "http://a.net/EN/?x=http://b/", "net/", "block"), (10, "s://ÄÖ.de/ß#x", "ÄÖ.de/ß", "block"),
    (11, "a\n://net/x\ny?z", "net/", "block"),
]


def test_longest_rule_wins(spark):
    folder = scratch(spark, "rules")
    write_rules(spark.createDataFrame(RULES, "host string, path string, verdict string"), folder)
    pages = spark.createDataFrame([(i, url, "h", 2) for i, url, _, _ in URLS], "page_id long, url string, host string, rule int")
    found = judge(pages, folder)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    key = lambda row: repr(row)
    assert sorted(((r.page_id, r.url, r.rule, r.verdict) for r in found.collect()), key=key) == sorted(URLS, key=key)
    assert judge(pages.limit(0), folder).count() == 0


def test_hosts_of_many_labels(spark):
    folder = scratch(spark, "rules")
    write_rules(spark.createDataFrame(RULES, "host string, path string, verdict string"), folder)
    labels = "a." * 50_000
    urls = [(1, f"http://{labels}net/"), (2, f"http://{labels}a.net/en/"), (3, f"http://net.{labels}"), (4, "http://.net/")]
    started = time.perf_counter()
    found = judge(spark.createDataFrame(urls, "page_id long, url string"), folder)
    assert {row.page_id: row.rule for row in found.collect()} == {1: "net/", 2: "a.net/en/", 3: None, 4: "net/"}
    assert time.perf_counter() - started < 20


def test_no_rules(spark):
    folder = scratch(spark, "rules")
    write_rules(spark.createDataFrame([], "host string, path string, verdict string"), folder)
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert [row.verdict for row in judge(pages, folder, default="block").collect()] == ["block"]


# archives

PAGES = [(5, "http://a/ é\r\nX: y", "<p>same"), (2, None, "<p>same"), (2, "http://b/", "<p>same"), (None, "http://c/", "<p>same"),
         (7, "u", None), (6, "v", ""), (9, "w", "WARC/1.1\r\n\r\n" + "long é" * 50_000), (10, "", "x\r\n\r\ny")]


def test_archives_round_trip(spark):
    folder = scratch(spark, "archives")
    pages = spark.createDataFrame([(*page, "d", 1) for page in PAGES], "page_id long, url string, html string, digest string, payload int")
    write_pages(pages, folder)
    found = sorted(read_records(spark, folder, verify=True).collect(), key=repr)
    assert len(found) == len(PAGES)
    for row in found:
        html = next(html for i, _, html in PAGES if i == row.page_id) or ""
        payload = html.encode()
        assert row.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert row.payload_bytes == len(payload)
        first = {"<p>same": 2, "": 6}.get(html)
        revisit = first is not None and row.page_id is not None and row.page_id > first
        assert row.record_type == ("revisit" if revisit else "response")
        assert row.refers_to == (first if revisit else None)
        assert row.payload is None if revisit else bytes(row.payload) == payload
    one = read_records(spark, folder).where("record_type = 'response' and url = 'http://b/'")
    assert [row.page_id for row in one.collect()] == [2]
    assert read_records(spark, folder, payload=False).where("url like 'http://%'").count() == 3
    assert read_records(spark, folder).where("payload_digest in ('x')").count() == 0


def test_appended_and_replaced_archives(spark):
    folder = scratch(spark, "archives")
    pages = [spark.createDataFrame([(at, f"http://{at}/", f"<p>{at}")], "page_id long, url string, html string") for at in range(3)]
    write_pages(pages[0], folder)
    write_pages(pages[1], folder)
    assert sorted(row.page_id for row in read_records(spark, folder, verify=True).collect()) == [0, 1]
    as_records(pages[2]).write.format("warc").mode("overwrite").option("path", folder).save()
    assert [row.page_id for row in read_records(spark, folder).collect()] == [2]


def foreign(kind, block, *headers, version="1.0"):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
FOREIGN = [
    (foreign("warcinfo", b"software: x\r\n\r\n", "WARC-Record-ID: <urn:uuid:1>"), ("warcinfo", None, b"software: x\r\n\r\n")),
    (foreign("request", b"GET / HTTP/1.1\r\n\r\n", "content-type: application/http; msgtype=request", "WARC-TARGET-URI: http://a/"), ("request", "http://a/", b"")),
    (foreign("response", HTTP + b"<p>a\r\n\r\nb", "content-type:application/http", "warc-target-uri:   http://a/", "X-Long: one", "  two", version="1.1"),
     ("response", "http://a/", b"<p>a\r\n\r\nb")),
    (foreign("response", HTTP, "Content-Type: application/http", "WARC-Target-URI: http://b/\u00e9", "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"").digest()).decode().lower()),
     ("response", "http://b/\u00e9", b"")),
    (foreign("resource", b"\x00\xff" * 700_000, "Content-Type: image/x", "WARC-Target-URI: http://c/"), ("resource", "http://c/", b"\x00\xff" * 700_000)),
    (foreign("revisit", HTTP, "Content-Type: application/http", "WARC-Target-URI: http://d/"), ("revisit", "http://d/", None)),
    (foreign("response", b"", "WARC-Target-URI: http://e/"), ("response", "http://e/", b"")),
]


@pytest.mark.parametrize("form", ["plain", "members", "one member", "file"])
def test_archives_from_elsewhere(spark, tmp_path, form):
    records = [record for record, _ in FOREIGN]
    if form == "plain":
        (tmp_path / "x.warc").write_bytes(b"".join(records))
    else:
        data = gzip.compress(b"".join(records)) if form == "one member" else b"".join(map(gzip.compress, records))
        (tmp_path / "x.warc.gz").write_bytes(data)
    (tmp_path / "notes.txt").write_text("no archive")
    path = f"{tmp_path}/x.warc.gz" if form == "file" else str(tmp_path)
    found = read_records(spark, path, verify=True).collect()
    wanted = [row for _, row in FOREIGN]
    assert [(row.record_type, row.url, row.payload) for row in found] == wanted
    for row, (_, _, payload) in zip(found, wanted):
        length = None if payload is None else len(payload)
        digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (row.page_id, row.refers_to, row.payload_bytes, row.payload_digest) == (None, None, length, digest)
    light = read_records(spark, path, payload=False)
    assert [row.payload_bytes for row in light.collect()] == [row.payload_bytes for row in found]
    for condition, test in (
        ("url = 'http://a/'", lambda row: row[1] == "http://a/"),
        ("url like 'http://b/\u00e9%'", lambda row: row[1] == "http://b/\u00e9"),
        ("record_type in ('response', 'resource')", lambda row: row[0] in ("response", "resource")),
    ):
        assert [row.url for row in light.where(condition).collect()] == [row[1] for row in wanted if test(row)]
    digest = base64.b32encode(hashlib.sha1(b"<p>a\r\n\r\nb").digest()).decode()
    assert [row.url for row in light.where(f"payload_digest = '{digest}'").collect()] == ["http://a/"]


def test_addresses_come_back_as_given(spark):
    folder = scratch(spark, "archives")
    urls = ["http://a/\u00e9 x", "http://a/%C3%A9%20x", "http://a/\r\nX: y", "\u2028", "plain", ""]
    pages = spark.createDataFrame([(at, url, "x") for at, url in enumerate(urls)], "page_id long, url string, html string")
    write_pages(pages, folder)
    records = read_records(spark, folder, payload=False)
    assert {row.page_id: row.url for row in records.collect()} == dict(enumerate(urls))
    for at, url in enumerate(urls):
        assert [row.page_id for row in records.where(F.col("url") == url).collect()] == [at]


def test_empty_archive(spark):
    folder = scratch(spark, "archives")
    write_pages(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert read_records(spark, folder).count() == 0


# decontamination


def word_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items):
    windows = []
    for item_id, text in items:
        words = word_list(text)
        n = min(13, len(words))
        windows += [(item_id, words[at : at + n]) for at in range(len(words) - n + 1) if n]
    rows = []
    for doc_id, text in docs:
        words, hit, found = word_list(text), set(), set()
        for (item_id, window), at in itertools.product(windows, range(len(words))):
            if words[at : at + len(window)] == window:
                hit |= set(range(at, at + len(window)))
                found |= {str(item_id)} - {"None"}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((doc_id, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(rows, key=repr)


LONG = "One two THREE four, five six seven eight nine ten eleven twelve thirteen fourteen É fifteen"
ITEMS = [(1, LONG), (20, "short Item"), (3, None), (4, "..."), (5, LONG), (None, "no id here"), (7, "a a a a a a a a a a a a a a")]
DOCS = [(1, "x " + LONG.lower() + " y"), (2, "ten eleven twelve"), (3, None), (4, ""), (None, "a short item and no id here"),
        (5, "a " * 40), (6, "z " * 5000 + LONG), (1, "x " + LONG.lower() + " y"), (1, "other"), (8, "É é short,ITEM")]


def test_contamination(spark):
    items = spark.createDataFrame([(*item, "h", 1) for item in ITEMS], "item_id long, text string, hash string, n int")
    found = contamination(docs_frame(spark, DOCS), items).drop("items")
    assert sorted((tuple(row) for row in found.collect()), key=repr) == brute_contamination(DOCS, ITEMS)
    table = docs_frame(spark, DOCS)
    clean = decontaminate(table, items)
    assert clean.columns == table.columns
    assert clean.count() == sum(not row[5] for row in brute_contamination(DOCS, ITEMS))
    assert contamination(table.limit(0), items).count() == 0
    assert contamination(table, items.limit(0)).where("n_hit > 0").count() == 0


# near-duplicates


def brute_components(docs, size, share=0.8):
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        many = max(1, len(words) - size + 1) if words else 0
        sets.append({tuple(words[at : at + size]) for at in range(many)})
    group = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
            old, new = group[j], group[i]
            group = [new if one == old else one for one in group]
    rows = []
    for at, (doc_id, _) in enumerate(docs):
        ids = [docs[other][0] for other in range(len(docs)) if group[other] == group[at] and docs[other][0] is not None]
        component = min(ids, default=None) if sets[at] else doc_id
        rows.append((doc_id, len(sets[at]), component, doc_id == component))
    return sorted(rows, key=repr)


def families(seed, families_, members, edits):
    import random

    pick = random.Random(seed)
    docs = []
    for _ in range(families_):
        base = [pick.choice("abcdefghijklmnopqrstuvwxyz") * pick.randint(1, 9) + str(pick.randint(0, 300)) for _ in range(80)]
        for _ in range(members):
            words = list(base)
            for _ in range(pick.randint(0, edits)):
                words[pick.randrange(80)] = str(pick.random())
            docs.append((len(docs) * 7 % 1009, " ".join(words)))
    return docs


ODD = [(3000, None), (3001, ""), (3002, " \t"), (3003, "one"), (3004, "ONE"), (3005, "one two"), (None, "One  Two"), (None, None),
       (3006, "one two"), (3006, "one two"), (3006, "quite another text"), (3007, "long " * 20_000), (3008, "long " * 30)]


@pytest.mark.parametrize("members", [1024, 2])
def test_near_duplicates(spark, monkeypatch, members):
    monkeypatch.setattr(minhash, "MEMBERS", members)
    docs = families(members, 6, 14, 9) + ODD
    found = near_duplicates(docs_frame(spark, docs), words=2).drop("hash")
    assert sorted((tuple(row) for row in found.collect()), key=repr) == brute_components(docs, 2)


def test_one_row_of_each_component_stays(spark):
    docs = families(4, 5, 6, 2) + [(2000, "x y z x y"), (2000, "x y z x y"), (2001, None), (2002, None)]
    table = docs_frame(spark, docs)
    kept = deduplicate(table)
    assert kept.columns == table.columns
    wanted = [row for row in brute_components(docs, 5) if row[3]]
    assert sorted(row.doc_id for row in kept.collect()) == sorted({row[0] for row in wanted})
    assert deduplicate(table.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 11), (12, 11), (12, 13), (13, 10), (5, 5), (None, 1), (2, 1), (20, 4)]
    ring = [100 + i * 37 % 101 for i in range(101)]
    chain = list(zip(ring, ring[1:], strict=False))
    found = dict(tuple(row) for row in connected_components(spark.createDataFrame(edges + chain, "a long, b long")).collect())
    assert {found[i] for i in (1, 2, 3, 4, 20)} == {1} and {found[i] for i in (10, 11, 12, 13)} == {10}
    assert 5 not in found and {found[one] for one in ring} == {100}


# quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model = quality.train(docs, labels, sample=400)
    scored = quality.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "quality").collect()
    test = [(row.score, row.quality) for row in scored if zlib.crc32(str(row.doc_id).encode()) % 5 == 0]
    low, high = ([score for score, label in test if label == wanted] for wanted in (0, 1))
    better = sum(one < other for one in low for other in high) / (len(low) * len(high))
    assert len(low) > 3 and better > 0.95
    assert sum((score >= 0.3) == label for score, label in test) >= 0.95 * len(test)


def test_odd_documents_are_scored(spark):
    table = docs_frame(spark, [(1, None), (None, ""), (2, "x" * 200_000), (2, "word " * 50_000), (3, "LOUD!!")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (2, 0)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        model = quality.train(table, known)
        scores = [row.score for row in quality.score(table, model).collect()]
        assert len(scores) == 5 and all(0 <= score <= 1 for score in scores)
        assert quality.keep_good(table, model, 0.0).columns == table.columns
    assert quality.score(table.limit(0), model).count() == 0


# preferences


def test_shared_beginning_is_the_prompt(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "a"), (1, 2, "user", "a"),
             (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "b"), (2, 3, "assistant", None),
             (3, 0, None, None), (4, 0, None, None), (None, 0, "user", "x"), (5, None, "user", "x"), (6, 0, "assistant", "l" * 99_999)]
    turns = spark.createDataFrame([(*turn, "p") for turn in turns], "conv_id long, turn long, role string, text string, part string")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 6, None), (4, 98, 99), (1, 1, 2)], "pair_id long, chosen long, rejected long")
    rows = {row.pair_id: row for row in preference_pairs(turns, pairs).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].prompt == "<|user|>\nhi\n<|assistant|>\nyo\n"
    assert rows[1].chosen == "<|user|>\na\n" and rows[1].chosen_spans == []
    assert rows[1].rejected == "<|user|>\nb\n<|assistant|>\n\n"
    assert [tuple(span) for span in rows[1].rejected_spans] == [(11, 26)]
    assert rows[2].prompt == "<||>\n\n" and rows[2].chosen == rows[2].rejected == ""
    assert rows[3].prompt == "" and [tuple(span) for span in rows[3].chosen_spans] == [(0, len(rows[3].chosen))]
    assert preference_turns(turns.limit(0), pairs).count() == 0


def test_every_conversation_has_a_pair_that_shares_its_beginning(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 1, "assistant", "one"), (1, 2, "user", "bye"),
             (4, 0, "user", "so"), (4, 1, "assistant", "first"), (4, 2, "user", "and"), (4, 3, "assistant", "four"),
             (5, 0, "user", "nobody answers"), (9, 0, None, "x"), (9, 7, "assistant", "four"), (None, 0, "assistant", "y")]
    turns = spark.createDataFrame([(*turn, "p") for turn in turns], "conv_id long, turn long, role string, text string, part string")
    for per_part in (1, 2, 100):
        rows = {row.pair_id: row for row in paired(answer_turns(turns, per_part)).collect()}
        assert set(rows) == {1, 4, 5, 9}
        assert rows[1].prompt == "<|user|>\nhi\n" and rows[1].chosen == "<|assistant|>\none\n<|user|>\nbye\n"
        assert rows[1].rejected == "<|assistant|>\nfour\n<|user|>\nbye\n"
        assert [tuple(span) for span in rows[1].rejected_spans] == [(0, 19)]
        assert rows[4].prompt == "<|user|>\nso\n<|assistant|>\nfirst\n<|user|>\nand\n"
        assert rows[4].chosen == "<|assistant|>\nfour\n" and rows[4].rejected == "<|assistant|>\none\n"
        assert [tuple(span) for span in rows[4].chosen_spans] == [(0, 19)]
        assert rows[5].prompt == "<|user|>\nnobody answers\n" and rows[5].chosen == rows[5].rejected == ""
        assert rows[9].prompt == "<||>\nx\n<|assistant|>\nfour\n" and rows[9].chosen == rows[9].rejected == ""
    assert paired(answer_turns(turns.limit(0))).count() == 0


def test_pairs_of_the_query_share_a_prompt(spark):
    rows = llm_queries.QUERIES["op9_preferences"](spark, FOLDER).collect()
    ids = {row.conv_id for row in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()}
    assert {row.pair_id for row in rows} == ids and len(rows) == len(ids)
    assert sum(bool(row.prompt and row.chosen and row.rejected) for row in rows) > len(rows) / 2


# Merkle trees


def test_edited_fingerprints(spark):
    docs = [(1, "aé𝄞\nb."), (3, None), (4, ""), (None, "no id"), (7, "one line"), (9, "x" * 100_001), (8, "one line"), (5, "..")]
    rows = {row.doc_id: row for row in edited_fingerprints(docs_frame(spark, docs), per_part=2).collect()}
    order = sorted(docs, key=lambda doc: -1 if doc[0] is None else doc[0], reverse=True)
    for (doc_id, text), (next_id, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following, row = text or "", following or "", rows[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (row.fingerprint == row.edited_fingerprint) == (text == edited)
        assert (row.fingerprint == rows[next_id].fingerprint) == (text == following)
        assert (row.near_edited == 1) == (text == edited) or row.near_edited < 1
        assert 0 <= row.near_next <= 1 and (row.near_next == 1 or text != following)
    again = edited_fingerprints(docs_frame(spark, [*docs, (7, "one line"), (7, "two"), (1, None)]))
    assert again.count() == len(docs) + 3
    assert edited_fingerprints(docs_frame(spark, [])).count() == 0
    assert edited_fingerprints(docs_frame(spark, [(1, "ab")])).first().edited_sha256 == hashlib.sha256(b"aa").hexdigest()


def test_many_rows_of_two_ids(spark):
    """Rows of one id meet one next text, so their number does not multiply."""
    rows = spark.range(10_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), "id", F.repeat(F.lit(" x"), (F.col("id") % 400).cast("int"))).alias("text"))
    started = time.perf_counter()
    found = edited_fingerprints(rows)
    assert found.count() == 10_000
    assert time.perf_counter() - started < 60
    least = rows.where("doc_id = 1").agg(F.min("text")).first()[0]
    text = "text 8" + " x" * 8
    half = len(text) // 2
    edited = text[: len(text) - half] + least[:half]
    assert found.where(F.col("edited_sha256") == hashlib.sha256(edited.encode()).hexdigest()).select("doc_id").distinct().count() == 1


def test_an_edit_moves_few_leaves(spark):
    """One character put into a long line without marks changes the leaves next to it only."""
    words = " ".join("".join(one) for one in itertools.islice(itertools.product("kamo", "riteli", "sund", "aeo"), 1200))
    texts = [(1, words), (2, words[:900] + "z" + words[900:]), (3, words.upper())]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {row.doc_id: row for row in frame.select("doc_id", leaves(leaves_of_paragraphs(F.col("text"))).alias("leaves")).collect()}
    same, other = (len(set(rows[1].leaves) & set(rows[at].leaves)) for at in (2, 3))
    assert len(rows[1].leaves) > 30 and same >= len(rows[1].leaves) - 2 and other < 5


def test_edits_are_located(spark):
    lines = [f"line {at}" for at in range(200)]
    before = [(1, "\n".join(lines)), (2, "same"), (3, None), (None, "x")]
    after = [(1, "\n".join([*lines[:50], "new", *lines[51:120], "inserted", *lines[120:]])), (2, "same"), (3, "now"), (4, "a\nb")]
    found = changed_paragraphs(docs_frame(spark, before), docs_frame(spark, after)).collect()
    assert sorted(tuple(row) for row in found) == [(1, 50, "new"), (1, 120, "inserted"), (3, 0, "now"), (4, 0, "a"), (4, 1, "b")]


# the pipeline


def test_each_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "best-fit packing":
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] >= counts[4]
    assert docs.select("doc_id").distinct().count() == counts[4]
