"""Top-k, WARC, mixing, URL filter, packing and licences against brute force."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from archlens.llm import mixing, packing, url_filter, warc
from archlens.llm.exact_topk import best_of, top_k
from archlens.llm.license_scan import TEMPLATES, bigrams_of, license_scan
from archlens.llm.queries import tokenizer_path
from tests.llm.helpers import ODD, docs
from tests.llm.test_pairs import vectors


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(rng.integers(-3, 4, 8) / 4)) for i in range(500)]  # many ties
    x = {i: np.floor(1024 * v.astype(np.float64)).astype(np.int64) for i, v in rows}
    got = defaultdict(list)
    for r in top_k(vectors(spark, rows), every=100).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 100, 200, 300, 400):
        want = sorted(((i, int(v @ x[q])) for i, v in x.items() if i != q), key=lambda p: (-p[1], p[0]))[:10]
        assert got[q] == want
    assert len(got) == 5


def test_top_k_leaves_candidates_out():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (40, 16))
    v = (centres[rng.integers(0, 40, 4000)] + rng.integers(-9, 9, (4000, 16))).astype(np.int64)
    far = np.sqrt(((v[:, None, :] - v[None, :48, :]) ** 2).sum(axis=2).astype(float))
    score, ids, done = best_of(v[77], far[77], v, far, np.arange(4000), 77, 10)
    want = sorted(((int(s), i) for i, s in enumerate(v @ v[77]) if i != 77), key=lambda p: (-p[0], p[1]))[:10]
    assert list(zip(score.tolist(), ids.tolist(), strict=True)) == want and done < 2000


def test_top_k_odd_vectors(spark):
    rows = [(0, [1, 2]), (1, None), (2, []), (3, [1, None]), (4, [1, float("inf")]), (5, [1, 2]), (6, [1, 2, 3]), (None, [1, 2]), (100, [1e30, 0])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(vectors(spark, rows)).collect()]
    assert got == [(0, 1, 5, 5 * 1024 * 1024)]
    assert top_k(vectors(spark, [])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, rule string, same int")


def test_warc_round_trip(spark):
    rows = [(5, "http://a/1", "<p>é</p>"), (3, "http://a/2", "<p>é</p>"), (9, None, None), (2, "http://a/3\r\nX: 1", ""), (7, "u", "x" * 300_000), (None, "n", "solo"), (3, "http://a/2", "<p>é</p>")]
    got = sorted((tuple(r) for r in warc.round_trip(pages(spark, rows)).collect()), key=str)
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = []
    for i, _, html in rows:
        html = html or ""
        first = min(j for j, _, h in rows if j is not None and (h or "") == html) if i is not None else None
        want.append((i, len(html.encode()), sha(html), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_reader_is_strict():
    one = warc.record(1, "u", b"abc", None) + warc.record(2, "u", b"abc", 1)
    assert [h["WARC-Type"] for h, _ in warc.read(one[i : i + 7] for i in range(0, len(one), 7))] == ["response", "revisit"]
    with pytest.raises(ValueError):
        list(warc.read([one[:-9]]))
    import gzip

    for a, b in ((b"abc\r\n", b"abd\r\n"), (b"Content-Length: 6", b"Content-Length: 5")):
        bad = gzip.decompress(warc.record(1, "u", b"abc", None)).replace(a, b)
        with pytest.raises(ValueError):
            list(warc.read([gzip.compress(bad)]))


def shared_out():
    def want(sizes):
        left, got = dict(sizes), {}
        weights = {s: 1 + i % 3 for i, s in enumerate(sizes)}
        total = sum(sizes.values())
        while left:
            rest = total - sum(got.values())
            share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
            over = [s for s in left if share[s] > 3 * sizes[s]]
            if not over:
                got |= share
                break
            for s in over:
                got[s] = 3 * sizes[s]
                del left[s]
        return got

    return want


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "c", "tiny", None]) if i % 40 else "tiny") for i in range(3000)]
    rows = [r if r[2] != "tiny" or r[0] % 40 == 0 else (r[0], r[1], "a") for r in rows]
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    ordered = {s: sizes[s] for s in [*sorted(x for x in sizes if x is not None), None]}
    want = shared_out()(ordered)
    taken = defaultdict(int)
    of = {i: s for i, _, s in rows}
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 30 for s in want)


def test_mixing_odd_rows(spark):
    got = mixing.mix(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r["doc_id"]: r["size"] for r in got}[6] == 80_000
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [(r["taken"], r["target"]) for r in mixing.mix(docs(spark, [(1, None), (2, "")])).collect()] == [(0, 0.0)] * 2


def test_urls(spark):
    urls = ["http://net/x", "https://A.Example.NET/en/1?q", "https://example.net/de/1", "http://x.example.com/de/a#f", "http://notexample.com/de/", "http://w.org/fr/", "http://w.org", "org/fr/", None, "", "x://", "http://Org/fr/../", "ftp://a.b.net", "http://a.net?x", "http://example.net/en/", "http://a.net:80/"]
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages(spark, [(i, u, "") for i, u in enumerate(urls)]), rules).collect()}

    def want(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    assert got == {i: want(u) for i, u in enumerate(urls)}
    assert url_filter.judge(pages(spark, []), rules).count() == 0
    assert [r["verdict"] for r in url_filter.judge(pages(spark, [(1, "http://net/", "")]), rules.where("false")).collect()] == ["allow"]


def test_bloom_has_no_false_negatives():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    bloom = url_filter.BlockedBloom(len(keys))
    bloom.add(keys)
    assert bloom.test(keys).all() and bloom.test(rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.01


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path())
    rows = [*ODD, (20, "<|endoftext|> a special token's string", "s"), (21, "  \n\n   x" * 300, "s"), (22, "ab" * 4000, "s")]
    got = packing.pack(docs(spark, rows), tokenizer_path(), bucket=8).collect()
    ids = {i: [*slow.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, p in pieces.items():
        times = sum(x[0] == i for x in rows)
        assert sum(n for _, n in p) == times * len(ids[i])
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(4)
    lengths = sorted((rng.randrange(1, 1025) for _ in range(3000)), reverse=True)
    rooms, want = [], []
    for n in lengths:
        fits = [w for w, room in enumerate(rooms) if room >= n]
        if not fits:
            rooms.append(1024)
            fits = [len(rooms) - 1]
        w = min(fits, key=lambda w: rooms[w])
        want.append(1024 - rooms[w])
        rooms[w] -= n
    got = packing.best_fit(lengths)
    assert [o for _, o in got] == want and max(w for w, _ in got) + 1 == len(rooms)


def test_licences(spark):
    mit = TEMPLATES["mit-grant"]
    rows = [(1, "x\nReleased under the MIT License.\ny z"), (2, "released UNDER the mit licence"), (3, mit.replace("free of charge", "for nothing").replace(" to ", "\nto ")), (4, "\n".join([TEMPLATES["gpl-3.0"], "", TEMPLATES["cc-by-nc-4.0"]])), *[(10 + i if i is not None else None, t) for i, t, _ in ODD]]

    def want(text):
        import re

        text = text or ""
        units = text.split("\n") + [p for p in re.split(r"\n *\n", text) if "\n" in p.strip(" ")]
        hits = []
        for u in units:
            a = set(bigrams_of(u))
            for k, t in TEMPLATES.items():
                b = set(bigrams_of(t))
                if a and 2 * len(a & b) >= 0.8 * (len(a) + len(b)):
                    hits.append((-2 * len(a & b) / (len(a) + len(b)), k))
        return ",".join(sorted({k for _, k in hits})), len(hits), min(hits)[1] if hits else None

    got = {r["doc_id"]: (r["licenses"], r["n_matches"], r["best_license"]) for r in license_scan(docs(spark, rows)).collect()}
    for i, t, *_ in rows:
        if i != 14:
            assert got[i] == want(t), i
    assert got[3][0] == "mit-grant" and got[2][1] == 0 and len(got) == len({r[0] for r in rows})
    assert license_scan(docs(spark, [])).count() == 0 and license_scan(docs(spark, rows), {}).count() == len(got)


def test_top_k_leaves_chunks_out(spark, monkeypatch):
    from archlens.llm import exact_topk

    monkeypatch.setattr(exact_topk, "CHUNK", 64)
    monkeypatch.setattr(exact_topk, "QUERIES", 8)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = [(i, np.float32(centres[i % 30] / np.linalg.norm(centres[i % 30]) + rng.standard_normal(16) * 0.01)) for i in range(1800)]
    x = {i: np.floor(1024 * v.astype(np.float64)).astype(np.int64) for i, v in rows}
    got, work = defaultdict(list), {}
    for r in top_k(vectors(spark, rows), every=60, evaluated=True).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        work[r["query_id"]] = r["evaluated"]
    for q in range(0, 1800, 60):
        assert got[q] == sorted(((i, int(v @ x[q])) for i, v in x.items() if i != q), key=lambda p: (-p[1], p[0]))[:10]
    assert sum(work.values()) < 0.3 * 30 * 1800


def test_faster_tokenizer_is_used_only_where_it_agrees():
    import copy
    import json

    import public_tokenizers

    model = json.load(open(tokenizer_path(), encoding="utf-8"))
    assert packing.ranked(model, public_tokenizers.PATTERN)
    for change in (lambda m: m["model"]["merges"].reverse(), lambda m: m.update(normalizer={"type": "NFC"}), lambda m: m.update(pre_tokenizer={"type": "Whitespace"}), lambda m: m["pre_tokenizer"].update(add_prefix_space=True)):
        other = copy.deepcopy(model)
        change(other)
        assert not packing.ranked(other, public_tokenizers.PATTERN)
