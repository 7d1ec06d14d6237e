from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quire.llm import decontaminate, langid, mixing, neardup, queries, repeatgroups, repeats, secrets, sstable, tokencount, transport, urlfilter

from .conftest import by_key, prose


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# 1 url filter

RULES = queries.URL_RULES


def judged(url):
    """Host, path and rule by the words of the contract."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark, small):
    odd = [None, "", "no scheme", "http://", "http://A.Example.COM/EN/x?y#z", "https://www.example.com/en/1", "https://x.www.example.com/en/1", "ftp://notexample.com/", "http://a.com", "http://net/es/1", "http://b.net/fr/2?x", "http://É.net/es/", "a://b://c.com/d", "http://h.org/1/2/3#f"]
    urls = [(i, u) for i, u in enumerate(odd * 2)] + [(r.page_id, r.url) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in urls], "page_id bigint, url string, host string, purity double")
    got = urlfilter.judge(df, RULES).collect()
    assert by_key(got, "page_id", "host", "path", "rule") == sorted(((i, *judged(u)) for i, u in urls), key=repr)
    assert all(r.verdict == dict(RULES)[r.rule] for r in got if r.rule) and {r.verdict for r in got} == {"allow", "block"}


def brute_templates(rows):
    """(host, plain) to (template, purity) from (host, plain, good, bad), a place at a time."""
    U = urlfilter
    smooth = lambda good, bad, p: (good + U.PRIOR * p) / (good + bad + U.PRIOR)
    paths, hosts, out = {}, {}, {}
    for host, plain, good, bad in rows:
        own = paths.setdefault(host, {}).setdefault(plain, [0, 0, 0])
        for i, x in enumerate((1, good, bad)):
            own[i] += x
        parts = host.split(".")
        for k in [*range(2, len(parts)), None]:
            d = hosts.setdefault((k is None, host if k is None else ".".join(parts[-k:])), [0, 0])
            d[0] += good
            d[1] += bad

    def place(host, done, some, purity):
        """some: rest of the path to those plain paths that have it here."""
        if not some:
            return
        rests = list(some)
        c = 0
        while all(len(r) > c for r in rests) and len({r[c] for r in rests}) == 1:
            c += 1
        done += "".join(f"/{x}" for x in rests[0][:c])
        if len(rests) == 1:
            out.update({(host, x): (done, purity) for x in some[rests[0]]})
            return
        branches = {}
        for r, own in some.items():
            key = f"/{r[c]}" if len(r) > c else ""
            after = "-" if not key else f"/{r[c + 1]}" if len(r) > c + 1 else ""
            b = branches.setdefault(key, {"next": Counter(), "good": 0, "bad": 0, "below": {}})
            for x in own:
                n, good, bad = paths[host][x]
                b["next"][after] += n
                b["good"] += good
                b["bad"] += bad
            b["below"].setdefault(r[c + 1 :], []).extend(own)
        total, names, kin = sum(sum(b["next"].values()) for b in branches.values()), {}, {}
        for key, b in branches.items():
            kin.setdefault(max(b["next"].items(), key=lambda x: (x[1], x[0]))[0], []).append(key)
        for mode, own in kin.items():
            pool = sum((branches[k]["next"] for k in own), Counter())

            def differs(k, some):
                bad, labelled = sum(branches[x]["bad"] for x in some), sum(branches[x]["good"] + branches[x]["bad"] for x in some)
                n, p = branches[k]["good"] + branches[k]["bad"], (bad + U.EVEN / 2) / (labelled + U.EVEN)
                return (branches[k]["bad"] / n - p if n else 0.0), U.Z * (p * (1 - p) * ((1 / n if n else 1) + 1 / (labelled + U.EVEN))) ** 0.5

            sides = {}
            for k in own:
                b, names[k] = branches[k], k
                n = sum(b["next"].values())
                if k and len(branches) > U.MAX_CHILDREN and n < U.MIN_SHARE * total:
                    names[k] = "/*"
                elif k and 0.5 * sum(abs(b["next"][x] / n - pool[x] / sum(pool.values())) for x in pool) <= U.MAX_DISTANCE + 1e-12:
                    d, spread = differs(k, own)
                    sides.setdefault("same" if abs(d) <= spread else "low" if d < 0 else "high", []).append(k)
            for side, members in sides.items():
                for k in members:
                    d, spread = differs(k, members)
                    if len(members) > 1 and abs(d) <= spread:
                        names[k] = f"/{{{side}~{mode[1:]}}}"
        merged = {}
        for k, b in branches.items():
            m = merged.setdefault(names[k], [0, 0, {}])
            m[0] += b["good"]
            m[1] += b["bad"]
            for r, own in b["below"].items():
                m[2].setdefault(r, []).extend(own)
        for name, (good, bad, below) in merged.items():
            pure = smooth(good, bad, purity)
            if name:
                place(host, done + name, below, pure)
            else:
                out.update({(host, x): (done, pure) for own in below.values() for x in own})

    for host, own in paths.items():
        p, last, parts = 0.5, None, host.split(".")
        for k in [*range(2, len(parts)), None]:
            good, bad = hosts[k is None, host if k is None else ".".join(parts[-k:])]
            p, last = (p if (good, bad) == last else smooth(good, bad, p)), (good, bad)
        place(host, "", {tuple(x.split("/")): [x] for x in own}, p)
    return {k: (t[1:], p) for k, (t, p) in out.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_op1_brute(spark, small, sf):
    folder = small.replace("sf0.001", sf)
    got = queries.op1_url_filter(spark, folder).collect()
    plain = {r.path: r.plain for r in spark.createDataFrame([(r.path,) for r in got], "path string").select("path", urlfilter.plain_path(F.col("path")).alias("plain")).collect()}
    says = dict(RULES) | {None: None}
    tree = brute_templates([(r.host, plain[r.path], int(says[r.rule] == "allow"), int(says[r.rule] == "block")) for r in got])
    for r in got:
        template, purity = tree[r.host, plain[r.path]]
        assert (r.template, r.purity) == (template, pytest.approx(purity, abs=1e-5))
        assert r.verdict == (says[r.rule] or ("block" if purity < urlfilter.MIN_PURITY else "allow"))


def test_many_rules_join(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a.b.com/x/y"), (2, "http://net/es/q"), (3, "http://q.org/")], "page_id int, url string")
    want = by_key(urlfilter.judge(df, RULES).collect(), "page_id", "rule", "verdict")
    monkeypatch.setattr(urlfilter, "INLINE_RULES", 0)
    assert by_key(urlfilter.judge(df, RULES).collect(), "page_id", "rule", "verdict") == want


def test_rules_of_equal_length(spark, monkeypatch):
    """That with the longer host decides, then the first in order, whether rules are written out or joined."""
    rules = [("x.com/ab", "allow"), ("y.x.com/", "block"), ("x.com/a/", "block"), ("z.com/ab", "allow")]
    df = spark.createDataFrame([(1, "http://y.x.com/abc"), (2, "http://x.com/abc"), (3, "http://q.y.x.com/a/b"), (4, "http://z.com/ab/")], "page_id int, url string")
    want = [(1, "y.x.com/", "block"), (2, "x.com/ab", "allow"), (3, "y.x.com/", "block"), (4, "z.com/ab", "allow")]
    for most in (200, 0):
        monkeypatch.setattr(urlfilter, "INLINE_RULES", most)
        assert by_key(urlfilter.judge(df, rules).collect(), "page_id", "rule", "verdict") == want


def test_templates(spark):
    good = [(f"/en/{i}", 1, 0) for i in range(30)] + [(f"/fr/{i}", 1, 0) for i in range(30)]
    bad = [(f"/win/{i}", 0, 1) for i in range(30)] + [(f"/user/name{i}x", 0, 1) for i in range(60)]
    rows = spark.createDataFrame([("h", urlfilter_path, g, b) for urlfilter_path, g, b in good + bad], "host string, path string, good long, bad long")
    t = {r.plain: r for r in urlfilter.learn_templates(rows.withColumn("plain", urlfilter.plain_path(F.col("path")))).collect()}
    assert t["/en/{num}"].template == t["/fr/{num}"].template == "/{low~{num}}/{num}" and t["/en/{num}"].purity > 0.9
    assert t["/win/{num}"].template == "/win/{num}" and t["/win/{num}"].purity < 0.1  # nothing else goes on like it
    assert t["/user/name3x"].template == "/user/*" and t["/user/name3x"].purity < 0.1


def test_purity_is_inherited(spark):
    """Branches without labels: like bad kin rejected, like good kin allowed; a host without labels takes after its domain, and one half is all that is left without any."""
    leaf = lambda host, top, good, bad, n=12: [(host, f"/{top}/{kind}/{i}", good, bad) for i in range(n) for kind in ("a", "b")]
    rows = leaf("bad.net", "es", 0, 1) + leaf("bad.net", "de", 0, 0) + leaf("good.net", "es", 1, 0) + leaf("good.net", "de", 0, 0)
    rows += leaf("x.shop.org", "es", 0, 1) + leaf("y.shop.org", "de", 0, 0) + leaf("new.net", "de", 0, 0)
    df = spark.createDataFrame(rows, "host string, plain string, good long, bad long")
    got = {(r.host, r.plain): (r.template, r.purity) for r in urlfilter.learn_templates(df).collect()}
    assert got["bad.net", "/de/a/1"][1] < urlfilter.MIN_PURITY < 0.9 < got["good.net", "/de/a/1"][1]
    assert got["bad.net", "/de/a/1"][0] == got["bad.net", "/es/a/1"][0]
    assert got["y.shop.org", "/de/a/1"][1] < urlfilter.MIN_PURITY and got["new.net", "/de/a/1"][1] == 0.5
    want = brute_templates(rows)
    assert {k: (t, pytest.approx(p)) for k, (t, p) in got.items()} == want


def test_templates_brute(spark):
    r = random.Random(9)
    segs = ["a", "b", "c", "", "{num}", "*", "x.html"]
    rows = []
    for _ in range(900):
        host = r.choice(["h", "a.b.c", "b.c", "d.b.c", "1.2.3.4.5.6.7.8", ""])
        path = "".join("/" + r.choice(segs[: r.randint(2, 7)]) for _ in range(r.randint(0, 6))) + (f"/w{r.randint(0, 80)}" if r.random() < 0.4 else "")
        label = r.choice([(0, 0), (0, 0), (1, 0), (0, 1)] if "a" in path else [(0, 0), (0, 1)])
        rows.append((host, path, *label))
    got = urlfilter.learn_templates(spark.createDataFrame(rows, "host string, plain string, good long, bad long")).collect()
    assert {(x.host, x.plain): (x.template, pytest.approx(x.purity)) for x in got} == brute_templates(rows) and len(got) == len({x[:2] for x in rows})


def test_long_paths_cost_no_jobs(spark):
    rows = [("h", f"/en/{k}", 1, 0) for k in "abc"]
    trap = "/trap" * 2_000
    jobs = lambda rows, name: (spark.sparkContext.setJobGroup(name, name), urlfilter.learn_templates(spark.createDataFrame(rows, "host string, plain string, good long, bad long")).collect(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))[1:]
    _, few = jobs(rows, "short")
    found, more = jobs([*rows, ("h", trap, 0, 0), ("h", trap + "/x", 0, 0), ("i", "/z" + trap, 0, 0)], "long")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.template for r in found} >= {trap, trap + "/x", "/z" + trap} and more <= 2 * few


def test_deep_branchings(spark, monkeypatch):
    """Forty branchings below one another and a host of ten labels, as by brute force."""
    monkeypatch.setattr(urlfilter, "ROUNDS", 4)
    rows = [("h", "/a" * k, k % 2, 1 - k % 2) for k in range(1, 42)]
    rows += [(f"{x}.9.8.7.6.5.4.3.2.1", "/p", int(x == "a"), int(x == "b")) for x in "abc"] + [("z.5.4.3.2.1", "/p", 0, 3), ("3.2.1", "/q", 2, 0)]
    got = {(r.host, r.plain): (r.template, pytest.approx(r.purity)) for r in urlfilter.learn_templates(spark.createDataFrame(rows, "host string, plain string, good long, bad long")).collect()}
    assert got == brute_templates(rows) and got["h", "/a" * 41][0] == "/a" * 41


def test_wildcards(spark):
    rows = spark.createDataFrame([("h", f"/tag/w{i}/feed", 0, 0) for i in range(400)], "host string, plain string, good long, bad long")
    assert {r.template for r in urlfilter.learn_templates(rows).collect()} == {"/tag/*/feed"}


def test_url_empty(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id int, url string"), RULES).collect() == []


# 2 transport streams


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=40_000))
def test_stream_round_trip(payload):
    media = transport.mux(payload)
    got = transport.demux(media)
    assert len(media) % 188 == 0 and got["payload"] == payload
    assert (got["lost"], got["repeated"], got["skipped"]) == (0, 0, 0)
    assert got["programs"] == [(1, 0x100, 0x101, 6)]
    assert [u[1] for u in got["units"]] == list(range(0, len(payload), transport.ACCESS_UNIT)) and all(u[5] for u in got["units"])
    assert [u[3] for u in got["units"]] == [u[1] * 90_000 // 8_000 for u in got["units"]]


def test_damaged_streams():
    payload = bytes(range(256)) * 200
    media = transport.mux(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert transport.demux(b"".join(packets[:5] + packets[6:]))["lost"] == 1
    twice = transport.demux(b"".join(packets[:5] + packets[4:]))
    assert (twice["repeated"], twice["lost"], twice["payload"]) == (1, 0, payload)
    shifted = transport.demux(b"junk" + media)
    assert shifted["skipped"] == 4 and shifted["payload"] == payload
    broken = bytearray(media)
    for i in range(0, len(media), 188):
        if broken[i + 1] & 0x1F == 0 and broken[i + 2] == 0:
            broken[i + 14] ^= 1
    assert transport.demux(bytes(broken))["programs"] == []
    assert transport.demux(b"")["payload"] == b"" and transport.demux(None)["payload"] is None


def test_op2(spark, hard, hard_rows, nothing):
    read = transport.read_media(transport.store_text(hard))
    got = read.select("doc_id", "n_bytes", "payload", "lost", F.size("programs").alias("p")).collect()
    want = []
    for r in hard_rows:
        raw = (r[1] or "").encode()
        want.append((r[0], len(raw), raw + b"\xff" * (-len(raw) % 576 if raw else 576), 0, 1))
    assert sorted(((r[0], r[1], bytes(r[2]), r[3], r[4]) for r in got), key=repr) == sorted(want, key=repr)
    assert transport.read_media(transport.store_text(nothing)).collect() == []


def plain_parser(media):
    """The stream's payload and packet identifiers, read a packet at a time by the words of the format."""
    counters, pids, data, payload = {}, Counter(), bytearray(), bytearray()

    def close():
        if data:
            assert data[:3] == b"\0\0\1" and data[3] == 0xBD and int.from_bytes(data[4:6]) == len(data) - 6
            payload.extend(data[9 + data[8] :])
            data.clear()

    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80
        pid, control, body = (p[1] & 31) << 8 | p[2], p[3] >> 4 & 3, p[4:]
        assert counters.setdefault(pid, p[3] & 15) == p[3] & 15 and control & 1
        counters[pid] = (p[3] + 1) & 15
        pids[pid] += 1
        if control & 2:
            body = body[1 + body[0] :]
        if pid == 0x101:
            if p[1] & 0x40:
                close()
            data.extend(body)
    close()
    return bytes(payload), pids


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=30_000))
def test_streams_by_a_plain_parser(payload):
    got, pids = plain_parser(transport.mux(payload))
    units = -(-len(payload) // transport.ACCESS_UNIT)
    assert got == payload and pids[0] == pids[0x100] == units


def test_first_packets():
    """Golden bytes: a program table as others write it, ours but for its checksum, and the head of the first elementary packet."""
    assert transport.section_crc(bytes.fromhex("00b00d0001c100000001f000")) == 0x2AB104B2
    media = transport.mux(b"\xaa" * 10)
    assert len(media) == 3 * 188
    assert media[:17].hex() == "474000100000b00d0001c100000001e100" and set(media[21:188]) == {255} and transport.section_crc(media[5:21]) == 0
    assert media[188:210].hex() == "474100100002b0120001c10000e101f00006e101f000" and transport.section_crc(media[193:214]) == 0
    assert media[376:388].hex() == "47410130" + "9f50" + "000000007e00" and media[-24:].hex() == "000001bd0012" + "848005" + "2100010001" + "aa" * 10


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_measured(payload, at_once):
    before, transport.AT_ONCE = transport.AT_ONCE, at_once
    try:
        got = transport.measured(payload)
    finally:
        transport.AT_ONCE = before
    assert got == {"energy": sum((x - 128) ** 2 for x in payload), "crossings": sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:], strict=False)), "levels": [sum(32 * i <= x < 32 * i + 32 for x in payload) for i in range(8)]}
    assert transport.measured(None) is None


def test_op2_query(spark, small):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    features = {}
    for r in queries.op2_transport(spark, small).collect():
        raw = texts[r.doc_id]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media = transport.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(media), sha(media))
        crossings = sum((a < 128) != (b < 128) for a, b in zip(payload, payload[1:], strict=False))
        said = dict(x.split("=") for x in r.feature.split(";"))
        assert said["energy"] == str(sum((x - 128) ** 2 for x in payload) // len(payload)) and said["crossings"] == str(crossings) and said["packets"] == str(len(media) // 188)
        features.setdefault(sha(payload), set()).add(r.feature)
    assert all(len(f) == 1 for f in features.values()) and len({min(f) for f in features.values()}) == len(features)


# 3 mixing


def test_op3_oracle(spark, small):
    got = queries.op3_poisson_mix(spark, small)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(queries.ORACLES["op3_poisson_mix"])
    names = [d[0] for d in want.description]
    assert by_key(got.collect(), *names) == sorted(want.fetchall(), key=repr)


def test_op3_is_native(spark, small):
    assert not re.search("Python|Arrow|Pandas", queries.op3_poisson_mix(spark, small)._jdf.queryExecution().executedPlan().toString())


def test_mix_hard(spark, hard, nothing, hard_rows):
    out = mixing.poisson_mix(hard, mixing.root_weights(hard), epochs=3.0)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = out.collect()
    copies = Counter((r.doc_id, r.text, r.source) for r in rows)
    given_ = Counter((r[0], r[1], r[3]) for r in hard_rows)
    assert copies.keys() <= given_.keys()
    assert all(r.n_copies * given_[r.doc_id, r.text, r.source] == copies[r.doc_id, r.text, r.source] for r in rows)
    assert {r.source for r in rows} == {"s0", "s1", None}
    assert mixing.poisson_mix(nothing, mixing.root_weights(nothing)).collect() == []


def test_mix_follows_weights(spark):
    df = spark.range(6_000).select(F.col("id").alias("doc_id"), F.lit("ten chars.").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0)], "source string, weight double")
    n = {r.source: r["count"] for r in mixing.poisson_mix(df, weights, 2.0).groupBy("source").count().collect()}
    assert abs(n["a"] - 9_000) < 300 and abs(n["b"] - 3_000) < 200
    many = mixing.poisson_mix(df.limit(3), weights.where("source = 'a'"), 1_200.0)
    assert many.agg(F.max("rate")).first()[0] > mixing.PART and abs(many.count() - 1_200) < 200


def test_mix_spreads_equal_keys(spark):
    """A null key in all rows fills all partitions."""
    df = spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("ten chars.").alias("text"), F.lit("a").alias("source"), F.lit(7).alias("_mix_row"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = mixing.poisson_mix(df, mixing.root_weights(df), 5.0)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "_mix_row" not in out.columns and len(sizes) == 4 and max(sizes) < 1.3 * min(sizes)


# 4 decontamination


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((key, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


COLUMNS4 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _items(hard_rows):
    texts = [r[1] for r in hard_rows if r[1]]
    cut = lambda t, a, n: " ".join(t.split()[a : a + n])
    return [(1, cut(texts[1], 10, 40)), (1, cut(texts[1], 10, 40)), (1, cut(texts[5], 300, 20)), (None, cut(texts[5], 310, 20)), (None, "one"), (2, cut(texts[1], 12, 14)), (3, "one"), (4, "two WORDS"), (5, None), (6, " !! "), (7, cut(texts[5], 100, 13)), (8, cut(texts[5], 100, 12) + " nowhere"), (9, "ab" * 400), (2_000, "not in any document at all")]


def test_contamination_brute(spark, hard, hard_rows, monkeypatch):
    items = _items(hard_rows)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_contamination([(r[0], r[1]) for r in hard_rows], items)
    index = decontaminate.build_index(hard)
    assert by_key(decontaminate.contamination(decontaminate.find_items(index, table)).collect(), *COLUMNS4) == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    assert len(list(decontaminate.item_blocks(table))) > 3
    for together in (100, 2):
        monkeypatch.setattr(decontaminate, "TOGETHER", together)
        assert by_key(decontaminate.contamination(decontaminate.find_items(index, table)).collect(), *COLUMNS4) == want


def test_contamination_oracle(spark, hard, hard_rows, tmp_path):
    """Repeated and null items, and the query's own SQL."""
    docs, items = f"{tmp_path}/documents.parquet", f"{tmp_path}/benchmark.parquet"
    hard.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").write.parquet(docs)
    spark.createDataFrame(_items(hard_rows), "item_id bigint, text string").write.parquet(items)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.op4_decontaminate(spark, str(tmp_path)).collect()
    assert by_key(got, *COLUMNS4) == sorted(con.execute(f"SELECT {', '.join(COLUMNS4)} FROM ({queries.ORACLES['op4_decontaminate']})").fetchall(), key=repr)


def test_contamination_segments(spark, hard, hard_rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 1_000)
    items = _items(hard_rows)
    index = decontaminate.build_index(hard)
    found = decontaminate.find_items(index, spark.createDataFrame(items, "item_id bigint, text string"))
    assert by_key(decontaminate.contamination(found).collect(), *COLUMNS4) == brute_contamination([(r[0], r[1]) for r in hard_rows], items)


def test_contamination_empty(spark, hard, hard_rows, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_items(decontaminate.build_index(nothing), none).collect() == []
    rows = decontaminate.contamination(decontaminate.find_items(decontaminate.build_index(hard), none)).collect()
    assert len(rows) == len(hard_rows) and not any(r.contaminated for r in rows)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma alpha")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id int, text string")
    index = decontaminate.build_index(docs)
    hits = lambda slop: {r.key: [tuple(h) for h in r.hits] for r in decontaminate.find_items(index, items, slop=slop).collect()}
    assert hits(0) == {1: [], 2: [(0, 3)], 3: []}
    assert hits(1) == {1: [(0, 4)], 2: [(0, 3)], 3: []}


def brute_near(words, item, slop):
    """Words that occurrences of item cover: ascending places with slop others at most between two."""
    hit = set()

    def go(places):
        if len(places) == len(item):
            hit.update(range(places[0], places[-1] + 1))
            return
        for p in range(places[-1] + 1, min(len(words), places[-1] + slop + 2)) if places else range(len(words)):
            if words[p] == item[len(places)]:
                go([*places, p])

    go([])
    return sorted(hit)


@pytest.mark.parametrize("segment", [1, 400, 1 << 20])
def test_proximity_brute(spark, monkeypatch, segment):
    """Whatever shares a segment, and so is rare or frequent in it: terms of one item, a term twice, longer items."""
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    r = random.Random(8)
    docs = [(i, " ".join(r.choice("abcd" if i % 3 else "aabc") for _ in range(r.randint(0, 25)))) for i in range(60)]
    items = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(1, 6)))) for i in range(12)] + [(50, "a a"), (51, "a b a"), (52, "d")]
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id int, text string").repartition(2))
    table = spark.createDataFrame(items, "item_id int, text string")
    for slop in (0, 1, 3):
        got = {x.key: ({p for h in x.hits for p in range(h.start, h.end)}, x["items"]) for x in decontaminate.find_items(index, table, slop=slop).collect()}
        for k, text in docs:
            hits = {i: brute_near(text.split(), t.split(), slop) for i, t in items}
            assert got[k] == (set().union(*hits.values()), sorted(str(i) for i, h in hits.items() if h)), (slop, k)


# 5 repeats


def brute_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[1:] > gone[:-1]).sum() + gone[0])
        out.append((len(x), int(gone.sum()), spans, sha(bytes(b for b, g in zip(x, gone, strict=False) if not g))))
    return out


def _removed(df):
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return df.select("doc_id", "n_bytes", n.alias("n"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")).collect()


@pytest.mark.parametrize("cap", [4_096, 1])
def test_repeats_brute(spark, hard, hard_rows, monkeypatch, cap):
    monkeypatch.setattr(repeats, "CAP", cap)
    monkeypatch.setattr(repeats, "BLOCK", 3_000)
    want = sorted(((r[0], *b) for r, b in zip(hard_rows, brute_repeats([r[1] for r in hard_rows]), strict=True)), key=repr)
    got = _removed(repeats.remove_repeats(hard))
    assert by_key(got, "doc_id", "n_bytes", "n", "s", "h") == want and sum(w[2] for w in want) > 10_000


def test_repeats_random(spark):
    r = random.Random(7)
    parts = [prose(r.randint(20, 60), 900 + i) for i in range(12)]
    texts = ["".join(r.choice(parts)[r.randint(0, 80) :] for _ in range(r.randint(1, 5))) for _ in range(80)] + ["z" * 900, "z" * 250 + "y", "zy" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = sorted(((i, *b) for i, b in enumerate(brute_repeats(texts))), key=repr)
    assert by_key(_removed(repeats.remove_repeats(df)), "doc_id", "n_bytes", "n", "s", "h") == want


def places(texts, s):
    return sorted((t, i) for t, x in enumerate(texts) for i in range(len(x) - len(s) + 1) if x[i : i + len(s)] == s)


def found_groups(df):
    groups = {}
    for x in repeatgroups.repeat_groups(df).collect():
        groups.setdefault((x.group, x.length), []).append((x.doc_id, x.start))
    return sorted((n, sorted(own)) for (_, n), own in groups.items())


@pytest.mark.parametrize(("cap", "reach", "most"), [(4_096, 512, 1 << 16), (3, 512, 1 << 16), (4_096, 256, 512)])
def test_repeat_groups(spark, monkeypatch, cap, reach, most):
    """All maximal repeats with all occurrences, however long, whatever the caps: as the full suffix array has them."""
    for name, value in (("CAP", cap), ("REACH", reach), ("MOST_REACH", most)):
        monkeypatch.setattr(repeatgroups, name, value)
    monkeypatch.setattr(repeats, "BLOCK", 2_500)
    r = random.Random(11)
    parts = [prose(n, 300 + n) for n in (45, 46, 60, 180)]
    texts = [prose(20, 400 + i) + " ".join(r.sample(parts, 2)) + prose(20, 500 + i) for i in range(8)]
    texts += [parts[3], parts[3], parts[3][:900], "pre" + parts[3][:900], "z" * 215, "z" * 206, "zy" * 105 + parts[0], texts[0], texts[0] + "!", "", "short"]
    want = repeats.maximal_repeats([t.encode() for t in texts], 200)
    assert max(n for n, _ in want) > 1_000 and len(want) > 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    assert found_groups(df) == want


def test_repeat_groups_hard(spark, hard, hard_rows, nothing):
    """Groups cover just what is removed."""
    own = repeatgroups.repeat_groups(hard).collect()
    gone = Counter((x.doc_id, k) for x in own for k in range(x.start, x.start + x.length)).keys()
    cut = {(x.doc_id, k) for x in repeats.remove_repeats(hard).collect() for s in x.spans for k in range(s.start, s.end)}
    assert gone == cut and repeatgroups.repeat_groups(nothing).collect() == []


def test_repeats_empty(spark, nothing):
    assert repeats.remove_repeats(nothing).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", max_size=14), max_size=4))
def test_maximal_repeats(texts):
    raw = [t.encode() for t in texts]
    places = {}
    for t, x in enumerate(raw):
        for i in range(len(x)):
            for j in range(i + 2, len(x) + 1):
                places.setdefault(x[i:j], []).append((t, i))
    want = []
    for s, own in places.items():
        side = lambda d, own=own, s=s: {raw[t][k] if 0 <= (k := i - 1 if d < 0 else i + len(s)) < len(raw[t]) else (t, i) for t, i in own}
        if len(own) > 1 and len(side(-1)) > 1 and len(side(1)) > 1:
            want.append((len(s), sorted(own)))
    assert repeats.maximal_repeats(raw, 2) == sorted(want)


# 6 secrets


def brute_spans(text):
    """Spans by plain expressions over the whole text, each kind on its own; the base and its digest."""
    text = text or ""
    out = [(m.start(), "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 8]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    out.sort(key=lambda x: (x[0], secrets.KINDS.index(x[1])))
    return out, sha(",".join(f"{k}:{a}:{b}" for a, k, b in out))


def brute_jwt(text):
    out, at = [], 0
    while m := re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+").search(text, at):
        good = "alg" in (secrets._json_part(m[1]) or {}) and secrets._json_part(m[2]) is not None
        out += [(m.start(), m.end())] * good
        at = m.end() if good else m.start() + 1
    return out


def test_secrets(spark, hard, hard_rows, nothing):
    fill = "0123456789abcdefghijklmnopqrstuv"[:30]
    tagged = "ghp_" + fill + secrets.base62_crc(fill)
    key = base64.b64encode(b"key material").decode()
    pgp = f"-----BEGIN PGP PRIVATE KEY BLOCK-----\n\n{key}\n={base64.b64encode(secrets.crc24(b'key material').to_bytes(3)).decode()}\n-----END PGP PRIVATE KEY BLOCK-----"
    jwt = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"none"}', b'{"a":1}', b"sig"))
    assert jwt.startswith("eyJ")
    words = secrets.automaton()
    kinds = lambda t: [s.kind for s in secrets.find(t, words)]
    assert kinds(f"x {tagged} y") == ["github"] and kinds(f"x {tagged[:-1]}0 y") == []
    assert kinds("npm_" + fill + secrets.base62_crc(fill)) == ["npm"]
    assert kinds(f"é {jwt}.") == ["jwt"] and kinds("eyJhb.cde.f") == []
    assert kinds(pgp) == ["pgp"] and kinds(pgp.replace("\n=", "\n=A")) == []
    assert kinds('API_KEY = "abcdefgh", İ password:short, PassWord: longenough AKIAABCDEFGHIJKL ' + "0f" * 16) == ["assign", "assign", "access", "hex"]
    got = secrets.digest_spans(secrets.scan_secrets(hard)).collect()
    want = []
    for r in hard_rows:
        base, digest = brute_spans(r[1])
        n = Counter(k for _, k, _ in base)
        want.append((r[0], n["assign"], n["access"], n["hex"], digest))
    assert by_key(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)
    assert secrets.scan_secrets(nothing).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "passwd", "secret", "ſecret", "token", "toKen", "API_KEY", "apikey", "AKIA", "akia", "ABCD1234", ":", "=", " ", '"', "'", "İ", "é", "deadbeef", "0123", "\n", "-", "x" * 9])))
def test_secrets_brute(parts):
    text = "".join(parts)
    got = [(s.start, s.kind, s.end) for s in secrets.find(text, secrets.automaton()) if s.kind in ("assign", "access", "hex")]
    assert got == brute_spans(text)[0]


_B64 = [base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"none"}', b'{"a":1}', b'{"alg":{"b":2}}', b"x")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*_B64, "eyJ", "EYJ", ".", ".", ".", " ", "é", "-", "ab"])))
def test_jwt_brute(parts):
    text = "".join(parts)
    assert [(s.start, s.end) for s in secrets.find(text, secrets.automaton()) if s.kind == "jwt"] == brute_jwt(text)


def test_secrets_with_long_headers():
    header = base64.urlsafe_b64encode(('{"alg":"none","x":"' + "é" * 60_000 + '"}').encode()).decode().rstrip("=")
    token = f"{header}.{_B64[1]}.sig"
    key = base64.b64encode(b"key material").decode()
    block = "-----BEGIN PGP PRIVATE KEY BLOCK-----\n" + "Comment: line\n" * 100 + f"\n{key}\n={base64.b64encode(secrets.crc24(b'key material').to_bytes(3)).decode()}\n-----END PGP PRIVATE KEY BLOCK-----"
    assert len(header) > 100_000
    found = secrets.find(f"a {token} b {block} c", secrets.automaton())
    assert [(s.kind, s.start, s.end) for s in found if s.kind in ("jwt", "pgp")] == [("jwt", 2, 2 + len(token)), ("pgp", 5 + len(token), 5 + len(token) + len(block))]


def test_secrets_take_linear_time():
    import time

    nested = base64.urlsafe_b64encode(b'{"a":' * 200_000).decode().rstrip("=")
    head = "Comment: -----BEGIN PGP PRIVATE KEY BLOCK-----\n"
    for text in ("eyJ" * 350_000, "eyJ" * 350_000 + "." + _B64[1] + ".x", nested + "." + _B64[1] + ".x", _B64[0] + "." + nested + ".x", "-----BEGIN PGP PRIVATE KEY BLOCK-----\n" + head * 20_000, "token" * 200_000, "ghp_" * 250_000, "AKIA" * 250_000):
        began = time.perf_counter()
        secrets.find(text, secrets.automaton())
        assert time.perf_counter() - began < 5  # a second at most where nothing else runs


# 7 token counts


def test_token_counts(spark, hard, hard_rows, nothing, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted(((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in hard_rows), key=repr)
    cache = f"file://{tmp_path}/cache"
    assert by_key(tokencount.count_tokens(hard, "piece_bpe_32k.model", cache).collect(), "doc_id", "n_bytes", "n_tokens") == want
    size = spark.read.parquet(cache).count()
    assert size == len({r[1] or "" for r in hard_rows})
    assert by_key(tokencount.count_tokens(hard, "piece_bpe_32k.model", cache).collect(), "doc_id", "n_bytes", "n_tokens") == want
    assert spark.read.parquet(cache).count() == size
    tokencount.count_tokens(hard, "byte_bpe_50k.json", cache).collect()
    assert spark.read.parquet(cache).count() == 2 * size
    assert tokencount.count_tokens(nothing, "piece_bpe_32k.model").collect() == []


# 8 languages


def test_language_accuracy(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op8_language(spark, sf).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_hard(spark, hard, hard_rows, nothing):
    model = langid.train(hard)
    got = langid.identify(hard, model).collect()
    assert len(got) == len(hard_rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und")
    texts = {r[0]: r[1] for r in hard_rows}
    assert {r.doc_id for r in got if r.lang_pred == "und" and r.doc_id is not None} == {k for k, t in texts.items() if k is not None and not re.search(r"[^\W\d_]", t or "")}
    empty = langid.train(nothing)
    assert {(r.lang_pred, r.score, r.known) for r in langid.identify(hard, empty).collect()} == {("und", 0.0, 0.0)}
    assert langid.identify(nothing, model).collect() == []


def test_language_backoff():
    model = langid.build([("a", "house", 9), ("a", "the", 50), ("b", "haus", 9), ("b", "das", 50)])
    s = langid.Scorer(model)
    lang = lambda t: s([t.encode()])[0][0]
    assert lang("the house") == "a" and lang("DAS") == "b" and lang("houses") == "a" and lang("haustür") == "b"
    assert s([b"!! 12", None]) == [("und", 0.0, 0.0)] * 2


def brute_language(counts, text):
    """Language, score and familiarity by the words of the module, a word at a time."""
    languages = sorted({x[0] for x in counts})
    lower = lambda t: re.findall(r"[^\W\d_]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isalpha() or ord(c) > 127 else " " for c in t))
    words = [w for token in lower(text or "") for w in re.findall(r"[^\W\d_]+", token.lower())]
    if not words or not languages:
        return "und", 0.0, 0.0
    by_word, by_gram = {x: Counter() for x in languages}, {x: Counter() for x in languages}
    grams = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]
    for x, w, n in counts:
        by_word[x][w] += n
        for size in range(1, langid.MAX_N + 1):
            for g in grams(w, size):
                by_gram[x][g] += n
    vocabulary, pieces = {w for c in by_word.values() for w in c}, {g for c in by_gram.values() for g in c}
    log = lambda c, x, all_: np.log((c[x] + langid.SMOOTHING) / (sum(c.values()) + langid.SMOOTHING * len(all_)))
    mean, known = [], 0.0
    for x in languages:
        total = 0.0
        for w in words:
            if w in vocabulary:
                total += log(by_word[x], w, vocabulary)
                continue
            for n in range(min(langid.MAX_N, len(w) + 2), 0, -1):
                if seen := [g for g in grams(w, n) if g in pieces]:
                    total += sum(log(by_gram[x], g, pieces) for g in seen) / len(seen)
                    break
            else:
                total += min(log(by_gram[x], g, pieces) for g in pieces)
        mean.append(total / len(words))
    for w in words:
        tried = grams(w, min(langid.TRIED, len(w) + 2))
        known += 1 if w in vocabulary else sum(g in pieces for g in tried) / len(tried)
    weight = [np.exp((m - max(mean)) * min(len(words), langid.EVIDENCE)) for m in mean]
    return languages[mean.index(max(mean))], max(weight) / sum(weight), known / len(words)


def test_language_brute(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    learn = docs.where(~langid.held_out()).collect()
    counts = Counter((r.lang, w) for r in learn for t in langid.tokens((r.text or "").encode()) for w in langid.words_of(t))
    counts = [(*k, n) for k, n in counts.items()]
    got = {r.doc_id: (r.lang_pred, r.score, r.known) for r in queries.op8_language(spark, small).collect()}
    some = [r for r in docs.where(langid.held_out()).collect() if len(r.text or "") < 700][:8]
    assert len(some) == 8
    for r in some:
        lang, score, known = brute_language(counts, r.text)
        assert got[r.doc_id] == (lang, pytest.approx(score, abs=2e-4), pytest.approx(known, abs=1e-5))
    model = langid.train(docs.where(~langid.held_out()))
    for text in ("zzyzx qqq Ünverstehen", "the–and, l'être 12ab", "Ж"):
        lang, score, known = brute_language(counts, text)
        assert langid.Scorer(model)([text.encode()]) == [(lang, pytest.approx(score, abs=2e-4), pytest.approx(known, abs=1e-5))]


def test_language_built_in_parts(monkeypatch):
    counts = [(x, w, n) for n, x in enumerate("ab", 1) for w in set(prose(60, n).lower().split())]
    want = langid.build(counts)
    monkeypatch.setattr(langid, "BUILT_AT_ONCE", 7)
    got = langid.build(counts)
    assert got.grams.keys() == want.grams.keys() and all(np.allclose(got.gram_scores[i], want.gram_scores[want.grams[g]]) for g, i in got.grams.items())


def test_language_forgets(monkeypatch):
    model = langid.build([("a", "house", 9), ("b", "haus", 9)])
    texts = [prose(40, i).encode() for i in range(20)]
    want = [langid.Scorer(model)([t])[0] for t in texts]
    monkeypatch.setattr(langid, "REMEMBERED", 30)
    monkeypatch.setattr(langid, "AT_ONCE", 7)
    s = langid.Scorer(model)
    assert [x for i in range(0, 20, 3) for x in s(texts[i : i + 3])] == want


def test_language_clashing_names(spark, hard):
    model = langid.train(hard)
    want = by_key(langid.identify(hard, model).collect(), "doc_id", "lang_pred", "score", "known")
    for name in ("lang_pred", "score", "known", "held_out", "_text"):
        hard = hard.withColumn(name, F.lit("x"))
    assert by_key(langid.identify(hard, model).collect(), "doc_id", "lang_pred", "score", "known") == want


def test_unfamiliar(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    least = langid.calibrate(docs.where(langid.held_out()), model)
    r = random.Random(5)
    noise = " ".join("".join(r.choice("bcdfghjklmnpqrstvwxzaeiou") for _ in range(7)) for _ in range(30))
    rows = spark.createDataFrame([(1, noise), (2, "это просто текст на другом языке"), (3, "zxq"), (4, docs.first().text)], "doc_id int, text string")
    found = langid.identify(rows, model, keep=("text",)).where(langid.unfamiliar(least))
    assert sorted(x.doc_id for x in found.collect()) == [1, 2]  # three letters are too few to judge
    assert langid.calibrate(docs.limit(0), model) == 0.0


def test_language_bound(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(docs, model_docs=50)
    assert set(model.languages) <= {"en", "fr", "de", "es"} and len(model.words) < len(langid.train(docs).words)


def test_language_keeps_rare(spark):
    letters = lambda i: "".join(chr(97 + int(c)) for c in f"{i:06}")
    common = [(" ".join(2 * [letters(i) for i in range(j, j + 4_100)]), "aa") for j in range(0, 82_000, 4_100)]
    model = langid.train(spark.createDataFrame([*common, ("seldom heard", "zz")], "text string, lang string"))
    assert model.languages == ["aa", "zz"] and len(model.words) == 82_002
    assert langid.Scorer(model)([b"heard"])[0][0] == "zz"


def test_language_sample_by_language(spark):
    rows = [(f"common {i}", "aa") for i in range(3_000)] + [(f"seldom {i}", "zz") for i in range(3)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), model_docs=100)
    at = model.words[b"seldom"]
    assert model.languages == ["aa", "zz"] and model.word_scores[at, 1] > model.word_scores[at, 0]


# 9 near-duplicates


def brute_components(rows, size, threshold):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize(("size", "threshold", "cap", "shingles"), [(3, 85, 2_048, 1 << 19), (5, 80, 2_048, 1 << 19), (3, 85, 3, 1 << 19), (3, 85, 2_048, 900)])
def test_near_duplicates_brute(spark, hard_rows, monkeypatch, size, threshold, cap, shingles):
    monkeypatch.setattr(neardup, "CAP", cap)
    monkeypatch.setattr(neardup, "CAP_SHINGLES", shingles)
    monkeypatch.setattr(neardup, "AT_ONCE", 500)
    r = random.Random(3)
    base = prose(200, 77).split()
    copies = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 9)}"
        copies.append((1_000 + i, " ".join(w)))
    rows = [(x[0], x[1]) for x in hard_rows] + copies
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = neardup.near_duplicates(df, size=size, threshold=threshold).collect()
    assert by_key(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, size, threshold)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_duplicates_chain(spark):
    """A chain of small edits is one component though its ends differ."""
    words = prose(120, 5).split()
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words[3 * i % 120] = f"new{i}"
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert by_key(neardup.near_duplicates(df, size=3, threshold=85).collect(), "doc_id", "n_shingles", "component_id") == brute_components(rows, 3, 85)


def test_near_duplicates_empty(spark, nothing, hard):
    assert neardup.near_duplicates(nothing).collect() == []
    assert neardup.near_duplicates(hard).count() == hard.count()


def test_signature_estimates():
    r = np.random.default_rng(1)
    errors = []
    for n in (5, 40, 900):
        for _ in range(40):
            x = r.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            a, b = x[: n + n // 2], x[n // 2 :]
            errors.append(float((neardup.signature(a, 64) == neardup.signature(b, 64)).mean()) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_bands():
    assert neardup.bands_for(85) == 16 and (1 - 0.85**4) ** 16 < neardup.MISS and (1 - 0.8**4) ** neardup.bands_for(80) < neardup.MISS


# 10 sorted-string tables


def _ids(text):
    from tokenizers import Tokenizer

    t = _ids.t = getattr(_ids, "t", None) or Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def test_shards(spark, hard, hard_rows, nothing, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD", 3_000)
    folder, shards = sstable.write_shards(hard, "byte_bpe_50k.json")
    rows = sstable.read_shards(spark, folder, shards, with_ids=True).orderBy("start").collect()
    ordered = sorted(hard_rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at = 0
    for got, r in zip(rows, ordered, strict=True):
        ids = [*_ids(r[1]), 0]
        assert (got.key, got.start, got.n_tokens, got.ids) == (r[0], at, len(ids), ids)
        assert got.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert shards.count() > 1
    files = spark.read.format("binaryFile").load(folder).where("path like '%.sst'").collect()
    readers = [sstable.Reader(bytes(f.content)) for f in files]
    for r in hard_rows:
        assert [*_ids(r[1]), 0] in [x.tolist() for reader in readers for x in reader.get(r[0])]
    assert all(reader.get(987_654) == [] for reader in readers)
    folder, shards = sstable.write_shards(nothing, "byte_bpe_50k.json")
    assert sstable.read_shards(spark, folder, shards).collect() == []


def test_shard_lookups():
    w = sstable.Writer(np.dtype("<u2"))
    keys = [None, -5, -5, 0, *range(3, 9_000, 3)]
    for i, k in enumerate(keys):
        w.add(sstable.encode_key(k), np.full(i % 40, i, "<u2").tobytes())
    data = w.finish()
    r = sstable.Reader(data)
    assert r.docs == len(keys) and len(r.blocks) > 1
    assert [len(x) for x in r.get(-5)] == [1, 2] and len(r.get(None)) == 1
    assert all(len(r.get(k)) == 1 for k in range(3, 9_000, 30)) and all(r.get(k) == [] for k in range(4, 9_000, 30))
    assert sum(r.may_hold(sstable.encode_key(k)) for k in range(100_000, 101_000)) < 40
    with pytest.raises(ValueError, match="ascend"):
        w.add(sstable.encode_key(-9), b"")
    with pytest.raises(ValueError, match="checksum"):
        list(sstable.Reader(data[:10] + b"\xff" + data[11:]).entries())


PIECES = [" ", "  ", "\n", "\n ", " \n", "\t", "a", "Word", "word,", "end.", "é", "1", "'s", "!", "!,", "<|endoftext|>", "💡", "\0", "\u00a0", "Ж", "ǆ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES)).map("".join), max_size=6))
def test_encoder_is_the_library(texts):
    e = sstable.encoder("byte_bpe_50k.json")
    assert [np.frombuffer(x, e.kind).tolist() for x in e(texts)] == [_ids(t) for t in texts]


def test_encoder_of_other_files(monkeypatch, tmp_path):
    """A file that cuts otherwise is encoded whole."""
    import json
    from pathlib import Path

    file = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8"))
    assert sstable.cuts_at_spaces(file)
    with_prefix = file | {"pre_tokenizer": file["pre_tokenizer"] | {"add_prefix_space": True}}
    word = file["added_tokens"][0] | {"content": "the end", "special": False} if file.get("added_tokens") else {"id": 5, "content": "the end", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False}
    for i, other in enumerate((with_prefix, file | {"normalizer": {"type": "Lowercase"}}, file | {"added_tokens": [*file.get("added_tokens", []), word | {"id": file["model"]["vocab"]["the"]}]})):
        assert not sstable.cuts_at_spaces(other)
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(other), encoding="utf-8")
        monkeypatch.setattr(public_tokenizers, "path", lambda _, path=path: str(path))
        from tokenizers import Tokenizer

        e, library = sstable.Encoder("other"), Tokenizer.from_file(str(path))
        texts = ["The end. and the end", "A  B\nÉ", ""]
        assert [np.frombuffer(x, e.kind).tolist() for x in e(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_scratch(spark, nothing, tmp_path):
    """What is stored inside goes, but not lasting folders nor what is written elsewhere; the session's limits come back."""
    from pathlib import Path

    from quire.llm import common

    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    path, here = common.shared_folder(spark), lambda p: Path(p.removeprefix("file://")).exists()
    with common.scratch():
        inside, lasting = common.shared_folder(spark), common.shared_folder(spark, lasting=True)
        for p in (path, inside, lasting):
            common.stored(spark.range(3).toDF("id"), path=p)
    assert here(path) and here(lasting) and not here(inside) and spark.read.parquet(path).count() == 3
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == limit


def test_shards_twice_in_one_folder(spark, hard, hard_rows):
    """A second run leaves the first one's shards as they are; each reads its own."""
    folder, one = sstable.write_shards(hard.limit(5), "byte_bpe_50k.json")
    _, two = sstable.write_shards(hard, "byte_bpe_50k.json", folder=folder)
    assert sstable.read_shards(spark, folder, one).count() == 5 and sstable.read_shards(spark, folder, two).count() == len(hard_rows)


def test_clashing_names(spark, hard):
    """Columns named as results are change nothing."""
    want7, want10 = by_key(tokencount.count_tokens(hard, "piece_bpe_32k.model").collect(), "doc_id", "n_bytes", "n_tokens"), None
    more = hard
    for name in ("content", "n_tokens", "n_bytes", "_key", "_text", "key", "start", "ids", "shard", "ids_crc32"):
        more = more.withColumn(name, F.lit("x"))
    assert by_key(tokencount.count_tokens(more, "piece_bpe_32k.model").collect(), "doc_id", "n_bytes", "n_tokens") == want7
    want10, got10 = (by_key(sstable.read_shards(spark, *sstable.write_shards(d, "byte_bpe_50k.json")).collect(), "key", "start", "n_tokens", "ids_crc32") for d in (hard, more))
    assert want10 == got10


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(sstable, "REMEMBERED", 60)
    e = sstable.Encoder("byte_bpe_50k.json")
    for i in range(20):
        t = prose(30, i)
        assert np.frombuffer(e([t, "the end."])[0], e.kind).tolist() == _ids(t)
