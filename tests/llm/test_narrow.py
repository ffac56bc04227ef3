"""Operators that work row by row, against plain Python."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from sparkloom import session
from sparkloom.llm import byte_bpe, common, mpeg_audio, quality_rules, secret_scans, sharding, warc

from brute import base_counts


def test_quality_counts(spark, docs, corpus):
    for rows in (docs, corpus):
        out = quality_rules.apply_rules(rows, into="__q")
        assert out.columns == [*rows.columns, "__q"] and out.count() == rows.count()
        for r in out.select("text", "__q").collect():
            q = r["__q"]
            assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == base_counts(r["text"])


def test_quality_lines(spark):
    clean = "This is a plain sentence of quite ordinary words in it."
    bad = ["Home | About | News | Contact | Login", "All rights reserved.", "BUY!! NOW!! CHEAP!! GOODS!! HERE!!", "one two three four five six seven no end", "go " * 30 + "."]
    text = "\n".join([clean, *bad, "", clean.replace("plain", "second")])
    q = quality_rules.apply_rules(spark.createDataFrame([(text,)], "text string")).first()["quality"]
    assert q["text"].split("\n") == [clean, "", clean.replace("plain", "second")]


def test_quality_cut_off(spark):
    """A long line that holds a sentence's end is prose that was cut off; a short one, or one without such an end, is not."""
    words = " ".join(f"word{i}" for i in range(18))
    texts = [f"{words}. And more", f"{words} and more", "Only six words. And then none"]
    rows = quality_rules.apply_rules(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [r["quality"]["text"] for r in rows] == [texts[0], "", ""]


def test_quality_stage(spark, docs, empty):
    out = quality_rules.filter_stage(spark, docs, "")
    assert out.columns == docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "1", "2", "7", "None"]
    assert quality_rules.filter_stage(spark, empty, "").count() == 0


SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
]


def spans_of(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m.group(g)) >= least)
    return ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in found)


def test_secrets(spark, docs, corpus):
    random.seed(4)
    bits = ["secret=", "token: ", "TOKEN", "=", "api_key", "apikey='", "abc", "abcdef", "AKIA", "A1B2C3D4E5F6G7H8", "0f" * 13, " ", "\n", "é🙂", "passwd"]
    made = spark.createDataFrame([(i, "".join(random.choices(bits, k=25))) for i in range(300)], "doc_id long, text string")
    for rows in (docs, corpus, made):
        out = secret_scans.scan(rows)
        listed = secret_scans.listed(secret_scans.F.filter("spans", lambda s: s["kind"] < 3))
        for r in out.select("text", listed.alias("x")).collect():
            assert r["x"] == spans_of(r["text"])


def test_secret_rules_and_redaction(spark, empty):
    text = "a -----BEGIN RSA PRIVATE KEY----- b ghp_" + "a1" * 20 + " c password=hunter22x d"
    rows = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, n_chars long")
    r = secret_scans.redact_stage(spark, rows, "").first()
    assert r["text"] == "a [REDACTED] b [REDACTED] c [REDACTED] d" and r["n_chars"] == len(r["text"])
    assert secret_scans.redact_stage(spark, empty, "").count() == 0


@pytest.mark.parametrize("pattern, query", [("[a-z]+", [[]]), ("abc(d|e)?", [["abc"]]), ("(?i:FOO)x*bar", [["bar", "foo"]]), ("abc|x", [[]]), ("a{3}", [["aaa"]])])
def test_trigram_query(pattern, query):
    assert sorted(sorted(s) for s in secret_scans.trigram_query(pattern)) == query


def test_sharding(spark, docs):
    table = sharding.fill(sharding.SHARDS)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(table) == sharding.SLOTS
    fewer = sharding.fill(sharding.SHARDS[:-1])
    assert sum(a != b for a, b in zip(table, fewer)) < len(table) / 8
    rows = sharding.place(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["slot"] == sharding.digest(key) % sharding.SLOTS and r["shard"] == sharding.SHARDS[table[r["slot"]]]
    with pytest.raises(ValueError):
        sharding.fill(("a", "b"), 10)


@pytest.fixture(scope="module")
def codec():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return byte_bpe.Codec(f.read(), P.PATTERN)


def test_bpe(codec):
    random.seed(2)
    letters = "aaaabc the he in étß中🙂 \n\n12\x1f 'll"
    texts = ["".join(random.choices(letters, k=random.randint(0, 200))) for _ in range(150)]
    texts += ["", "a" * 4000, "ab" * 900 + "é" * 300, "".join(random.choices("abcdeth", k=2000))]
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    ids = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [real.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_bpe_vocabulary_is_proper(codec):
    """Each entry is what its own bytes contract to, as if it weren't looked up whole."""
    raw = list(codec.ranks)
    assert codec.contract(raw) == [codec.ranks[t].to_bytes(4, "little") for t in raw]


def tiktoken_ids(codec, texts):
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    return [real.encode_ordinary(t) for t in texts]


def test_bpe_windows(codec):
    """Long pieces of every kind, among them runs whose tokens are longer than a window."""
    rng = random.Random(11)
    texts = ["-" * n for n in (49, 500, 1999)] + ["=" * 777 + "-" * 130, " " * 700, "\n" * 300, "hello" * 90, "abc" * 333, "\u00a0" * 200]
    texts += ["".join(rng.choices("aeiourstln", k=n)) for n in (50, 65, 700)] + ["".join(rng.choices("的一是不了人我在有他这中大来上国", k=900))]
    texts += [base64.b64encode(rng.randbytes(3000)).decode(), "".join(rng.choices("-=", [9, 1], k=1500)), "".join(rng.choices("aab", k=900))]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == tiktoken_ids(codec, texts)
    raw = ["".join(rng.choices("xyzzy", k=n)).encode() for n in (3, 8, 40, 200)]
    for size in (4, 16, 512):  # whatever the windows
        assert codec.contract_long(raw, size) == codec.contract(raw)


def test_bpe_megabyte(codec):
    """A megabyte of letters without a space, and a page of Chinese."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "".join(rng.choices("的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年", k=20_000))]
    began = time.perf_counter()
    ids = codec.encode(texts)
    assert time.perf_counter() - began < 120
    assert codec.decode(ids) == [t.encode() for t in texts]
    assert np.frombuffer(ids[1], "<u4").tolist() == tiktoken_ids(codec, texts[1:])[0]


def test_bpe_rows(spark, docs, empty):
    rows = byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert Counter(bytes(r["decoded"]) for r in rows) == Counter((r["text"] or "").encode() for r in docs.collect())
    assert byte_bpe.encode(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1402, 1403, 70000])
def test_audio_round_trip(size):
    payload = mpeg_audio.padded(random.Random(size).randbytes(size))
    data = mpeg_audio.store(payload)
    s = mpeg_audio.parse(data)
    assert mpeg_audio.load(data, s) == payload and s.crc_bad == 0 and s.crc_ok == len(s.offsets) and s.skipped == 0
    assert s.duration == Fraction(1152 * len(s.offsets), 32000) and s.table["frames"] == len(s.offsets) and s.table["bytes"] == sum(s.lengths)
    assert s.seek(Fraction(0)) == s.offsets[0] and s.seek(s.duration) is None


def test_audio_resynchronises():
    data = mpeg_audio.store(bytes(range(256)) * 40)
    whole = mpeg_audio.parse(data)
    cut = data[: whole.offsets[2]] + b"\xff\xfb\x00junk" + data[whole.offsets[2] :] + b"TAG" + b"song".ljust(125, b"\0")
    s = mpeg_audio.parse(cut)
    assert s.offsets == whole.offsets[:2] + [o + 7 for o in whole.offsets[2:]] and s.skipped == 7
    assert s.tags["v1:TITLE"] == "song"
    broken = bytearray(data)
    broken[whole.offsets[1] + 10] ^= 1
    assert mpeg_audio.parse(bytes(broken)).crc_bad == 1
    assert mpeg_audio.parse(b"").duration == 0 and mpeg_audio.parse(b"\xff" * 50).offsets == []


def test_audio_rows(spark, docs, empty):
    rows = mpeg_audio.probe(mpeg_audio.media(docs)).collect()
    want = Counter(hashlib.sha256(mpeg_audio.padded((r["text"] or "").encode())).hexdigest() for r in docs.collect())
    assert Counter(r["payload_sha256"] for r in rows) == want
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 for r in rows)
    assert mpeg_audio.probe(mpeg_audio.media(empty)).count() == 0
    assert zlib.crc32(mpeg_audio.padded(b"")) in {r["tail_crc32"] for r in rows}


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    given = [warc.ArcRecord("http://a/b?c=1", "1.2.3.4", "20230102030405", "text/html; charset=x", b"x\n\ny" * 9), warc.ArcRecord("http://é/ b", "::1", "2023", "text/html", b"")]
    back = list(warc.read_arc(warc.write_arc(given, version)))
    assert [(r.ip, r.date, r.mime, r.block) for r in back] == [(r.ip, r.date, r.mime, r.block) for r in given]
    assert warc.iso_date("20230102030405") == "2023-01-02T03:04:05Z"
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.write_arc(given, version)[:-40]))


@pytest.mark.parametrize("few, most", [(500_000, 32_000_000), (0, 200)])
def test_warc(spark, monkeypatch, few, most):
    """By broadcast and by shuffle, in one file a task and in several."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    monkeypatch.setattr(warc, "FILE_BYTES", most)
    rows = [(1, "u", "<a>"), (2, "u", "<a>"), (3, None, None), (4, "v", ""), (None, "w", "<a>"), (5, "x", "é\r\n\r\nWARC/1.0"), (1, "u", "<a>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.read_archives(spark, warc.write_archives(warc.originals(pages))).collect()
    sha = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    want = [(i, len((h or "").encode()), sha(h or ""), "revisit" if r else "response", r) for (i, _, h), r in zip(rows, [None, 1, None, 3, 1, None, None])]
    assert Counter(tuple(r) for r in out) == Counter(want)
    none = spark.createDataFrame([], pages.schema)
    assert warc.read_archives(spark, warc.write_archives(warc.originals(none))).count() == 0


def test_warc_files_are_bounded(spark):
    """A page of 50 MB among a thousand: files of at most FILE_BYTES, or of one page, each beginning with a warcinfo."""
    pages = spark.range(1000).selectExpr("id AS page_id", "'http://a/' || id AS url", "repeat(concat('<p>', id), if(id = 7, 12500000, 20000)) AS html").coalesce(1)
    path = warc.write_archives(warc.originals(pages))
    files = spark.read.format("binaryFile").load(path).select("length", "content").collect()
    assert sorted(f["length"] > 33_000_000 for f in files)[-2:] == [False, True] and len(files) > 3
    for f in files:
        kinds = [h["warc-type"] for h, _ in warc.read_warc(bytes(f["content"]))]
        assert kinds[0] == "warcinfo" and set(kinds[1:]) == {"response"} and (f["length"] < 33_000_000 or len(kinds) == 2)
    out = warc.read_archives(spark, path)
    assert out.agg(warc.F.count_distinct("page_id"), warc.F.sum("payload_bytes")).first() == pages.selectExpr("count(page_id)", "sum(length(html))").first()


V1 = b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Old Crawler\nURL IP-address Archive-date Content-type Archive-length\n"
V2 = b"filedesc://y.arc 0.0.0.0 19980101000000 text/plain 200 - - 0 y.arc 122\n2 0 Old Crawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
ONE = b"http://a.example/ 1.2.3.4 19970701000000 text/html 30\nHTTP/1.0 200 OK\r\n\r\nhello world"
TWO = b"http://b.example/x 5.6.7.8 19980102030405 text/html; charset=x 404 ABC - 99 y.arc 5\nno\n\n\n"
V1 = V1.replace(b" 76\n", b" %d\n" % (len(V1) - V1.index(b"\n") - 1))
V2 = V2.replace(b" 122\n", b" %d\n" % (len(V2) - V2.index(b"\n") - 1))


def test_arc_files(spark, tmp_path):
    """Hand-written archives: either version, both in one, gzipped by record and whole, newlines missing, lengths wrong."""
    import gzip

    given = {
        "one.arc": V1 + b"\n" + ONE + b"\n",
        "two.arc": V2 + b"\n" + TWO + b"\n",
        "joined.arc": V1 + ONE + b"\n" + V2 + TWO + ONE.replace(b"text/html 30", b"text/html 200 - - 7 y.arc 30"),  # some newlines missing
        "members.arc.gz": b"".join(map(gzip.compress, (V2 + b"\n", TWO + b"\n", TWO + b"\n"))),
        "whole.arc.gz": gzip.compress(V1 + b"\n" + ONE + b"\n"),
        "damaged.arc": V1 + b"\nnot a header\n" + ONE.replace(b" 30\n", b" 12\n") + b"\n" + ONE + b"\n" + ONE.replace(b" 30\n", b" 3000\n"),
        "cut.arc.gz": gzip.compress(V1 + b"\n") + gzip.compress(ONE)[:20],
        "empty.arc": b"",
    }
    for name, data in given.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read_arc_files(spark, f"{tmp_path}").collect()
    got = {}
    for r in rows:
        got.setdefault(r["file"].rpartition("/")[2], []).append((r["url"][7:8], r["ip"], r["date"], r["mime"], r["status"], bytes(r["payload"]), r["problem"]))
    one, two = ("a", "1.2.3.4", "1997-07-01T00:00:00Z", "text/html", None, b"hello world", None), ("b", "5.6.7.8", "1998-01-02T03:04:05Z", "text/html; charset=x", 404, b"no\n\n\n", None)
    assert got["one.arc"] == [one] and got["two.arc"] == [two] and got["whole.arc.gz"] == [one] and got["members.arc.gz"] == [two, two]
    assert got["joined.arc"] == [one, two, (*one[:4], 200, *one[5:])]
    lost = ("", "", None, "", None)
    assert got["damaged.arc"] == [(*lost, b"not a header\n", "no header line"), (*one[:6], "12 bytes declared"), one, (*one[:6], "3000 bytes declared")]
    assert set(got) == set(given) - {"empty.arc"} and got["cut.arc.gz"][-1] == (*lost, b"", "the rest can't be unzipped: the last member is cut")
    record = next(warc.read_arc(given["two.arc"]))
    headers, block = next(warc.read_warc(warc.to_warc(record, 3, None, "<i>")))
    assert headers["warc-date"] == "1998-01-02T03:04:05Z" and headers["warc-target-uri"] == "http://b.example/x" and block == b"no\n\n\n"


ODD = b"http://c.example/a b?c d 9.9.9.9 2024 1.2.3.4 19970701000000 text/html; charset=x 30\nHTTP/1.0 200 OK\r\n\r\nhello world"
DNS = b"dns:a.example 1.2.3.4 199707 text/dns 14\n19970701\nA 1.2"


def test_urls_with_spaces_and_other_types():
    """URLs up to the first address that a date follows, types with spaces, dates in part, records that are no HTTP answers."""
    spaced = ODD.replace(b" 9.9.9.9 2024", b"")
    rows = list(warc.read_arc(V1 + b"\n" + spaced + b"\n" + DNS + b"\n" + ONE + b"\n"))
    assert [(r.url, r.ip, r.mime, r.problem) for r in rows] == [("http://c.example/a b?c d", "1.2.3.4", "text/html; charset=x", None), ("dns:a.example", "1.2.3.4", "text/dns", None), ("http://a.example/", "1.2.3.4", "text/html", None)]
    heads = [next(warc.read_warc(warc.to_warc(r, f"x#{i}", None, "<i>")))[0] for i, r in enumerate(rows)]
    assert [h["warc-type"] for h in heads] == ["response", "resource", "response"] and [h["content-type"] for h in heads] == ["application/http; msgtype=response", "text/dns", "application/http; msgtype=response"]
    assert heads[0]["warc-target-uri"] == "http://c.example/a%20b?c%20d" and heads[1]["warc-date"] == "1997-07-01T00:00:00Z"
    two = V2 + b"\n" + TWO.replace(b"b.example/x", b"b.example/x y  z") + b"\n"
    assert [(r.url, r.status, r.mime) for r in warc.read_arc(two)] == [("http://b.example/x y  z", 404, "text/html; charset=x")]


@pytest.mark.parametrize("digits, want", [("2024", "2024-01-01T00:00:00Z"), ("20241399", "2024-01-01T00:00:00Z"), ("20240230120000", "2024-02-01T00:00:00Z"), ("20240229235960", "2024-02-29T23:59:00Z"), ("20240229120000123", "2024-02-29T12:00:00Z"), ("", "0001-01-01T00:00:00Z")])
def test_dates_are_dates(digits, want):
    assert warc.iso_date(digits) == want


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_many_members(monkeypatch, version, chunk):
    """A member for each of many records, or one for all, in time that grows with the bytes; parts of any size."""
    import gzip
    import time

    monkeypatch.setattr(warc, "CHUNK", chunk)
    n = 20_000 if chunk > 7 else 60
    given = [warc.ArcRecord(f"http://a/{i}", "1.2.3.4", "20230102030405", "text/html", warc.http_block(b"x\n" * 150, "text/html")) for i in range(n)]
    whole = warc.write_arc(given, version)
    head = whole.index(b"http://a/0 ")
    each = gzip.compress(whole[:head]) + b"".join(gzip.compress(warc.write_arc([r], version)[head:], 1) for r in given)
    began = time.perf_counter()
    for data in (each, gzip.compress(whole), whole, each + b"\0" * 100):
        assert [(r.url, r.block, r.problem) for r in warc.read_arc(data)] == [(r.url, r.block, None) for r in given]
    assert time.perf_counter() - began < 30
    with pytest.raises(ValueError):
        list(warc.read_arc(each[:-5]))
    cut = list(warc.read_arc(each + b"junk", strict=False))
    assert len(cut) == n + 1 and "unzipped" in cut[-1].problem


@pytest.mark.parametrize("most", [32_000_000, 700])
def test_arc_files_become_warc_files(spark, tmp_path, monkeypatch, most):
    """Archives of storage, converted: every record once, with its type and digest, behind a warcinfo that names its archive."""
    import gzip

    monkeypatch.setattr(warc, "warc_files", lambda name, content, f=warc.warc_files: f(name, content, most))
    (tmp_path / "in").mkdir()
    given = {"a.arc": V1 + b"\n" + ONE + b"\n" + DNS + b"\n" + ONE + b"\n", "b.arc.gz": b"".join(map(gzip.compress, (V2 + b"\n", TWO + b"\n", TWO + b"\n"))), "c.arc": V1 + b"\njunk\n" + ONE.replace(b" 30\n", b" 12\n"), "d.arc": b""}
    for name, data in given.items():
        (tmp_path / "in" / name).write_bytes(data)
    out = warc.convert_arc_files(spark, f"{tmp_path}/in")
    records, of_archive = [], Counter()
    for f in spark.read.format("binaryFile").load(out).collect():
        (first, about), *rest = warc.read_warc(bytes(f["content"]))
        assert first["warc-type"] == "warcinfo" and b"arc-version-block: " in about and all(h["warc-warcinfo-id"] == first["warc-record-id"] for h, _ in rest)
        of_archive[about.split(b"arc-file: ")[1].split(b"\r\n")[0].rpartition(b"/")[2]] += len(rest)
        records += rest
    assert of_archive == {b"a.arc": 3, b"b.arc.gz": 2, b"c.arc": 2}
    assert len({h["warc-record-id"] for h, _ in records}) == 7 and Counter(h["warc-type"] for h, _ in records) == {"response": 3, "resource": 4}
    assert all(h["warc-block-digest"] == "sha1:" + warc.sha1_32(b) and h["warc-payload-digest"] == "sha1:" + warc.sha1_32(warc.payload_of(b)) for h, b in records)
    assert sorted(h["x-problem"] for h, _ in records if "x-problem" in h) == ["12 bytes declared", "no header line"]
    assert {b for h, b in records if h["warc-target-uri"] == "dns:a.example"} == {b"19970701\nA 1.2"}


@pytest.mark.parametrize("mark", [b"TAG", b"ID3\3\0\0\0\0\0\x10", b"\xff\xfa\xe8\x00", b"\xff" * 9])
def test_audio_marks_in_payload(mark):
    """What looks like a tag or a header inside a payload, at every place from its end, is payload."""
    for size in (100, 500, 1500, 3000):
        for back in range(len(mark), min(size, 400)):
            text = bytearray(b"x" * size)
            text[size - back : size - back + len(mark)] = mark
            payload = mpeg_audio.padded(bytes(text))
            data = mpeg_audio.store(payload)
            s = mpeg_audio.parse(data)
            assert mpeg_audio.load(data, s) == payload and s.skipped == 0 and len(s.tags) == 1


def test_audio_random_payloads():
    random.seed(12)
    for _ in range(300):
        bits = random.choices([b"TAG", b"ID3", b"\xff", b"\xff\xfb\x90\x00", b"Xing", b"x" * 30, b"\0"], k=random.randint(0, 80))
        payload = mpeg_audio.padded(b"".join(bits))
        data = mpeg_audio.store(payload)
        assert mpeg_audio.load(data, mpeg_audio.parse(data)) == payload


def bit_crc(bits):
    value = 0xFFFF
    for b in bits:
        top = value >> 15 ^ b
        value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return value


def bits_of(raw):
    return [byte >> 7 - k & 1 for byte in raw for k in range(8)]


#: Header bytes of frames with checksums, and the bits after it that are covered when every allocation is `one`.
FRAMES = [
    (b"\xff\xfe\x54\x00", 256),  # MPEG-1 Layer I, 48 kHz, stereo
    (b"\xff\xfe\x54\x40", 4 * (2 * 4 + 28)),  # joint from subband 4
    (b"\xff\xfe\x54\xc0", 128),  # mono
    (b"\xff\xfc\xa4\x00", 2 * (11 * 4 + 12 * 3 + 4 * 2) + 2 * 2 * 27),  # Layer II, 192 kbit/s at 48 kHz: table a
    (b"\xff\xfc\xa0\x00", 2 * (11 * 4 + 12 * 3 + 7 * 2) + 2 * 2 * 30),  # at 44.1 kHz: table b
    (b"\xff\xfc\x24\xc0", 2 * 4 + 6 * 3 + 2 * 8),  # 48 kbit/s, mono: table c
    (b"\xff\xfc\x28\xc0", 2 * 4 + 10 * 3 + 2 * 12),  # at 32 kHz: table d
    (b"\xff\xf4\x80\x40", (4 * 2 * 4) + (7 * 3) + (19 * 2) + 2 * 2 * 30),  # MPEG-2 Layer II, joint from subband 4
    (b"\xff\xf2\x80\x00", 17 * 8),  # MPEG-2 Layer III, stereo
    (b"\xff\xe2\x80\xc0", 9 * 8),  # MPEG-2.5, mono
]


@pytest.mark.parametrize("raw, guarded", FRAMES)
def test_audio_layers(raw, guarded):
    """Frames of every version and layer, padded ones among them, with checksums made bit by bit."""
    padded = bytes([raw[0], raw[1], raw[2] | 2, raw[3]])
    made = []
    for k, head in enumerate((raw, padded, raw, padded, raw)):
        h = mpeg_audio.read_header(head)
        body = b"\xff" * 60 if k != 3 else b"\xff" * 20 + b"\x7f" * 40
        body = body.replace(b"\xff\xff", b"\xff\xdf") if h.layer == 3 else body
        body = b"\xff" * 0 + body
        covered = mpeg_audio.guarded_bits(body, h)
        if k != 3 and h.layer != 3:
            assert covered == guarded
        crc = bit_crc(bits_of(head[2:4]) + bits_of(body)[:covered]).to_bytes(2, "big")
        made.append((head + crc + body).ljust(h.length, b"\0")[: h.length])
    data = b"".join(made)
    s = mpeg_audio.parse(data)
    h = mpeg_audio.read_header(raw)
    assert s.lengths == [len(m) for m in made] and s.crc_ok == 5 and s.crc_bad == 0 and s.skipped == 0
    assert s.duration == Fraction(5 * h.samples, h.rate) and s.lengths[1] - s.lengths[0] == (4 if h.layer == 3 else 1)
    broken = bytearray(data)
    broken[len(made[0]) + 6] ^= 0x40
    assert mpeg_audio.parse(bytes(broken)).crc_bad == 1


def test_audio_free_format():
    frames = [b"\xff\xfb" + bytes([0x02 if k % 2 else 0x00, 0]) + b"\x11" * (500 + k % 2 - 4) for k in range(5)]
    s = mpeg_audio.parse(b"".join(frames) + b"TAG" + b"song".ljust(125, b"\0"))
    assert s.lengths == [500, 501, 500, 501, 500] and s.duration == Fraction(5 * 1152, 44100) and s.tags == {"v1:TITLE": "song"}


def test_audio_tables():
    """VBRI, and a Xing table with an encoder's delay and padding."""
    sound = [b"\xff\xfb\x90\x00".ljust(417, b"\0")] * 10
    vbri = b"VBRI" + bytes([0, 1, 0, 0, 0, 75]) + (4170).to_bytes(4, "big") + (10).to_bytes(4, "big") + bytes([0, 2, 0, 1, 0, 2, 0, 5, 8, 37, 8, 37])
    first = (b"\xff\xfb\x90\x00" + bytes(32) + vbri).ljust(417, b"\0")
    s = mpeg_audio.parse(first + b"".join(sound))
    assert s.table == {"kind": "VBRI", "bytes": 4170, "frames": 10, "toc": [2085, 2085]} and s.offsets[0] == 417 and len(s.offsets) == 10
    xing = b"Info" + (3).to_bytes(4, "big") + (10).to_bytes(4, "big") + (4170).to_bytes(4, "big") + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    s = mpeg_audio.parse((b"\xff\xfb\x90\x00" + bytes(32) + xing).ljust(417, b"\0") + b"".join(sound))
    assert (s.table["delay"], s.table["padding"]) == (576, 1000) and s.duration == Fraction(11520 - 1576, 44100)
    assert s.seek(Fraction(0)) == s.offsets[0] and s.seek(Fraction(600, 44100)) == s.offsets[1]


@pytest.mark.parametrize("major", [2, 3, 4])
def test_audio_id3(major):
    frame = {2: b"TT2" + (5).to_bytes(3, "big"), 3: b"TIT2" + (5).to_bytes(4, "big") + b"\0\0", 4: b"TIT2" + bytes([0, 0, 0, 5]) + b"\0\0"}[major] + b"\0song"
    tag = b"ID3" + bytes([major, 0, 0x10 if major == 4 else 0, 0, 0, 0, len(frame) + 20]) + frame + bytes(20) + (b"3DI".ljust(10, b"\0") if major == 4 else b"")
    s = mpeg_audio.parse(tag + b"\xff\xfb\x90\x00".ljust(417, b"\0") * 2)
    assert s.tags == {"TT2" if major == 2 else "TIT2": "song"} and s.offsets == [len(tag), len(tag) + 417] and s.skipped == 0


def test_audio_probe_of_any_bytes(spark):
    """Streams from elsewhere, bytes that are no stream, null; and columns named like the added ones."""
    real = b"\xff\xfb\x90\x00".ljust(417, b"\0") * 3
    rows = [(1, real, "f", 7), (2, b"no audio", "g", 8), (3, None, "h", 9), (4, b"", None, None), (5, mpeg_audio.store(bytes(64)), "i", 1)]
    out = mpeg_audio.probe(spark.createDataFrame(rows, "k int, media binary, feature string, Payload_Bytes int"))
    got = {r["k"]: r for r in out.collect()}
    assert [got[k]["feature"] for k in range(1, 6)] == ["f", "g", "h", None, "i"] and got[1]["Payload_Bytes"] == 7
    assert [got[k]["payload_bytes_"] for k in range(1, 6)] == [None] * 4 + [64]
    assert [got[k]["frame_count"] for k in range(1, 6)] == [3, None, None, None, 1] and [got[k]["media_bytes"] for k in range(1, 6)][:4] == [1251, 8, None, 0]
    assert got[1]["duration_samples"] == 3456 and got[1]["feature_"].startswith("frames=3;")


def test_clashing_names(spark):
    """Columns named like the inner and the added ones of every operator that passes columns on."""
    names = "__lines __worded __words __count_n_words quality __text __id __mask spans slot shard __at __slot __owner __row __new SPANS_ Slot_".split()
    text = "This is a plain sentence of quite ordinary words in it with password=hunter22x inside."
    rows = spark.createDataFrame([(1, text, 5, *names)], "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    kept = lambda r: [r[n] for n in names] == names
    r = quality_rules.apply_rules(rows).first()
    assert kept(r) and r["quality_"]["n_words"] == 14
    r = secret_scans.scan(rows).first()
    assert kept(r) and [tuple(s) for s in r["spans__"]] == [(text.index("password"), 0, text.index(" inside"))]
    r = sharding.place(rows, "doc_id").first()
    assert kept(r) and r["slot__"] == sharding.digest("1") % sharding.SLOTS and r["shard_"].startswith("shard-")
    for stage in (quality_rules.filter_stage, secret_scans.redact_stage):
        r = stage(spark, rows, "").first()
        assert kept(r) and r.asDict().keys() == set(rows.columns)


def test_many_secrets(spark):
    """200,000 matches in one text, and masks in a text of many pages."""
    text = "a token=abcdef1 b\n" * 200_000
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    r = secret_scans.scan(rows).select(secret_scans.F.size("spans").alias("n"), secret_scans.F.element_at("spans", -1).alias("last")).first()
    assert r["n"] == 200_000 and tuple(r["last"]) == (len(text) - 16, 0, len(text) - 3)
    assert secret_scans.redact_stage(spark, rows, "").first()["text"] == "a [REDACTED] b\n" * 200_000
    assert time.perf_counter() - began < 100


@pytest.mark.parametrize("page", [3, 7, 4096])
def test_masks_across_pages(spark, monkeypatch, page):
    """Overlapping and touching spans, and stretches without any, over pages of any size."""
    monkeypatch.setattr(secret_scans, "PAGE", page)
    random.seed(page)
    rows = []
    for i in range(120):
        text = "".join(random.choices("ab é🙂\n", k=random.randint(0, 60)))
        places = [sorted(random.choices(range(len(text) + 1), k=2)) for _ in range(random.choice([0, 1, 2, 6]))]
        rows.append((i, text, sorted((a, 0, b) for a, b in places if a < b)))
    docs = spark.createDataFrame(rows, f"doc_id long, text string, spans {secret_scans.NO_SPANS}")
    got = {r["doc_id"]: r["x"] for r in docs.select("doc_id", secret_scans.redact(secret_scans.F.col("text"), secret_scans.F.col("spans")).alias("x")).collect()}
    for i, text, spans in rows:
        out, at = "", 0
        for a, _, b in spans:
            if a >= at:
                out += text[at:a] + secret_scans.MASK
            at = max(at, b)
        assert got[i] == out + text[at:]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_secrets_by_broadcast_and_shuffle(spark, docs, monkeypatch, most):
    monkeypatch.setattr(secret_scans, "BROADCAST_ROWS", most)
    listed = secret_scans.listed(secret_scans.F.filter("spans", lambda s: s["kind"] < 3))
    got = Counter((r["text"], r["x"]) for r in secret_scans.scan(docs).select("text", listed.alias("x")).collect())
    assert got == Counter((r["text"], spans_of(r["text"])) for r in docs.collect())


@pytest.mark.parametrize("block", [1, 4, 256])
def test_running_values(spark, monkeypatch, block):
    monkeypatch.setattr(common, "BLOCK", block)
    rows = spark.createDataFrame([([],), ([5],), ([3, 0, 7, 2, 2, 9, 1, 4, 4],)], "v array<int>")
    got = [tuple(r) for r in rows.select(common.scanned(secret_scans.F.col("v"), lambda a, b: a + b), common.scanned(secret_scans.F.col("v"), secret_scans.F.greatest)).collect()]
    assert got == [([], []), ([5], [5]), ([3, 3, 10, 12, 14, 23, 24, 28, 32], [3, 3, 7, 7, 7, 9, 9, 9, 9])]


def test_no_local_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Fake:
        conf = Conf
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: Conf)})

    with pytest.raises(ValueError):
        session.scratch(Fake, "x")
