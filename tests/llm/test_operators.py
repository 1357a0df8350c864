"""Each operator against a brute-force version on awkward rows, on an empty table, and with clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from polymetric.llm import jaccard, langid, mixing, neighbours, packing, pii, quality, sharding, tokens, urls

from .fixtures import SCHEMA, awkward, clashing, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


# ---- 1 -----------------------------------------------------------------------


def test_tokens(docs, none, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = tokens.count_tokens(clashing(docs), limit=50).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    want = []
    for r in rows:
        n = len(sp.encode(r[1] or ""))
        want.append((r[0], len((r[1] or "").encode()), n, n > 50))
    same([tuple(r) for r in got], want)
    assert tokens.count_tokens(none).count() == 0


def test_tokens_fuzz():
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, c, rng = tokens.library(path), tokens.Counts(path, tokens.prove(path)), random.Random(1)
    parts = ["a", "th", " ", "  ", "\n", "\n\n", "▁", "<s>", "</s>", "<0x0A>", "\t", "\r", "é", "中", "😀", "\0", " the", "\u2028", "\u3000", "ing"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert c.count(t) == len(sp.encode(t)), repr(t)


def test_tokens_by_ranks(monkeypatch):
    """Pieces as ranks give the library's tokens; what they can't be given goes to the library, many pre-tokens a call, and stays cached."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, rng = tokens.library(path), random.Random(3)
    encode, unfit = tokens.ranks(path)
    own = sorted({p for i in range(sp.get_piece_size()) if len(p := sp.id_to_piece(i)) == 1 and p != tokens.MARK})
    pieces = [sp.id_to_piece(i).replace(tokens.MARK, " ") for i in range(300, 9000)]
    for _ in range(3000):
        t = " " + "".join(rng.choices(rng.choice([own, own[:90], pieces, ["a", "aa", "A", ".", "n", "e", " ", "é", "中"]]), k=rng.randint(1, 30)))
        if not unfit(t):
            assert len(encode(t)) == len(sp.encode(t[1:])), repr(t)
    assert not unfit(" the own Wörter,\n中") and all(map(unfit, [" a\0", " a  b", " a\t", " \U0001f9ff", " " + "x" * 500, " a\n" + "x" * 500]))
    calls, c = [], tokens.Counts(path, tokens.prove(path))
    texts = ["".join(rng.choices("abcdeé.,", k=7)) for _ in range(900)]
    text = "  ".join(texts)
    assert c.count(text) == len(sp.encode(text))
    c.sp = type("Counted", (), {"encode": lambda self, asked, **k: calls.append(asked) or sp.encode(asked, **k)})()
    assert c.count(text) == len(sp.encode(text)) and not calls
    monkeypatch.setattr(tokens, "CACHE", 1000)
    more = "  ".join("".join(rng.choices("uvwxyz\t", k=8)) for _ in range(900))
    for t in (more, text, more):
        assert c.count(t) == len(sp.encode(t))
        assert len(c.known) - len(c.base) <= 1000
    assert calls and all(isinstance(x, str) for x in calls) and len(calls) < 60
    monkeypatch.setattr(c, "ranks", None)
    monkeypatch.setattr(c, "apart", None)
    c.known, c.old = dict(c.base), {}
    assert c.count(text) == len(sp.encode(text))


def test_tokens_refuse_other_vocabularies(monkeypatch):
    class Crossing:
        def __getattr__(self, name):
            return {"get_piece_size": lambda: 1, "id_to_piece": lambda i: "a▁b"}.get(name, lambda i: False)

    monkeypatch.setattr(tokens, "library", lambda path: Crossing())
    with pytest.raises(ValueError):
        tokens.prove("any")


# ---- 2 -----------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_sharding(docs, rows, buckets):
    out = sharding.external_shuffle(clashing(docs), 4, buckets=buckets).select("doc_id", "text", "lang", "source", "n_chars", "shard", "slot").collect()
    same([tuple(r)[:5] for r in out], rows)
    counts = collections.Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(4))
    for s in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    again = sharding.external_shuffle(docs.repartition(5), 4, buckets=buckets or sharding.bucket_count(10**6, 4)).select("doc_id", "shard").collect()
    assert len(again) == len(rows)


def test_sharding_is_seeded_and_even(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text")
    a, b, c = (sorted(map(tuple, sharding.external_shuffle(d, 8, seed=s, buckets=5).select("doc_id", "shard", "slot").collect())) for d, s in ((df, 1), (df.repartition(7), 1), (df, 2)))
    assert a == b != c
    where = np.array([r[1] for r in a])
    assert abs(np.corrcoef(np.arange(4000), where)[0, 1]) < 0.06


def test_sharding_empty_and_files(none, docs, rows, tmp_path, spark):
    assert sharding.external_shuffle(none).count() == 0
    sharding.write_shards(sharding.external_shuffle(docs, 3), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == len(rows)


# ---- 3 -----------------------------------------------------------------------

URLS = [None, "", "nothing", "http://", "http://X.Example.COM/en/1?a=1#b", "https://www.example.com/en/", "http://a.www.example.com/en/x", "ftp://a.net/es/x", "http://net/fr/", "http://a.net", "http://xnet/es/1", "x://y://z/en/", "http://casino-win.example.org/en/1", "http://www.library.example.org/de/9", "://q?r=/en/", "http://example.com#/en/", "http://u@h:80/p/", "http://" + "a" * 50_000 + ".org/x", "http://é.org/ü", "http://casino-win.example.org/en/1"]


def split_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = re.split(r"[?#]", u.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path


def test_urls(spark):
    df = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string"))
    got = {r["page_id"]: r for r in urls.filter_urls(df).collect()}
    for i, u in enumerate(URLS):
        host, path = split_url(u)
        fits = [r for r in urls.RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].partition("/")[2])]
        best = max(fits, key=lambda r: len(r[0]), default=(None, None))
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[0]), u
        assert r["verdict"] == best[1] if best[0] else r["verdict"] in ("allow", "block")
        assert host or r["verdict"] == "allow"
    assert got[12]["verdict"] == "block" and got[13]["verdict"] == "allow"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_held_out():
    rows = urls.labelled_urls()
    assert rows == urls.labelled_urls() and len(rows) < 2000
    hosts = sorted({r[0] for r in rows})
    out = {h for h in hosts if zlib.crc32(h.encode()) % 5 == 0}
    w = urls.train([r for r in rows if r[0] not in out])
    test = [r for r in rows if r[0] in out]
    p = urls.score(w, [r[0] for r in test], [r[1] for r in test])
    assert np.mean((p > 0.5) == [bool(r[2]) for r in test]) > 0.9


# ---- 4 -----------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, pattern, ok in ((2, CARD, lambda d: 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0), (3, PHONE, lambda d: 9 <= len(d) <= 15)):
        out += [(k, *m.span()) for m in pattern.finditer(t) if ok(re.sub("[^0-9]", "", m[0]))]
    return out


def test_pii_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choices("ab1.@@-_ 9é+(4)", k=rng.randint(0, 24)))
        assert pii.base_spans(t) == plain_base(t), repr(t)


def test_pii(docs, none, rows):
    got = pii.find(clashing(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    want = []
    for r in rows:
        b = plain_base(r[1] or "")
        said = ",".join(f"{pii.KINDS[k]}:{x}:{y}" for k, x, y in b)
        want.append((r[0], *(sum(s[0] == k for s in b) for k in range(4)), hashlib.sha256(said.encode()).hexdigest()))
    same([tuple(r)[:6] for r in got], want)
    text = {r[0]: r[1] for r in rows}
    found = {r["doc_id"]: [text[r["doc_id"]][int(a) : int(b)] for _, a, b in (s.split(":") for s in r["spans"].split(","))] for r in got if r["spans"]}
    assert found[109] == ["a.b@mail.example.com", "10.2.3.4", "4111 1111 1111 1111", "+1 (599) 555-3756"]
    assert found[110] == ["anna [at] mail [dot] org", "(599) 555-3756"] and set(found) == {109, 110}
    assert pii.find(none).count() == 0 and pii.mask(none).count() == 0


def test_pii_mask(docs, rows):
    got = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert got[109] == "write <EMAIL> or <PHONE> at <IP> with <CARD>" and got[100] is None and got[3] == rows[3][1]
    assert got[110] == "call <PHONE>. <EMAIL>"


def test_field_held_out_and_gap():
    field = pii.train(pii.labelled_table())
    good = total = 0
    for words, labels in pii.labelled_table(99):
        shapes = [pii.token_shape(w) for w in words]
        got = field.viterbi(field.emissions(shapes)[None], np.array([len(shapes)]))[0]
        good, total = good + int((got == labels).sum()), total + len(labels)
    assert good / total > 0.98
    # Decoding around odd tokens gives what decoding whole texts gives.
    rng, gap = random.Random(3), field.gap()
    pool = ["the", "is.", "Foo,", "12", "(555)", "555-1234", "anna", "[at]", "mail", "[dot]", "com", "a@b", "1.2.3.4", "4111/1111/1111/1111", "+1", "x" * 100, "7" * 90]
    for _ in range(1500):
        text = " ".join(rng.choices(pool, [9] * 3 + [1] * 14, k=rng.randint(0, 30)))
        spans = [m.span() for m in pii._token.finditer(text)]
        shapes = [pii.token_shape(text[a:b]) if b - a <= pii.LONG else "long" for a, b in spans]
        labels = field.viterbi(field.emissions(shapes)[None], np.array([len(shapes)]))[0] if spans else []
        base, want, i = pii.base_spans(text), [], 0
        while i < len(spans):
            j = i + 1
            if labels[i]:
                while j < len(spans) and labels[j] == labels[i]:
                    j += 1
                s = pii.checked(int(labels[i]) - 1, text, spans[i][0], spans[j - 1][1])
                if s and not any(a < s[1] and s[0] < b for _, a, b in base):
                    want.append((int(labels[i]) - 1, *s))
            i = j
        assert sorted(pii.added_spans([text], [base], field, gap, {})[0]) == sorted(want)


def test_pii_side_by_side():
    field = pii.train(pii.labelled_table())
    gap, rng, cache = field.gap(), random.Random(7), {}

    def number(n):
        return "".join(rng.choices("0123456789", k=n))

    def phone():
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])

    def card():
        body = number(15)
        n = next(body + d for d in "0123456789" if pii.luhn(body + d))
        return rng.choice("/.").join((n[:4], n[4:8], n[8:12], n[12:]))

    def shown(text):
        base, more = next(pii.spans_of([text], field, gap, cache))
        return pii.masked(text, base + more)

    assert shown("call 555-123-4567 555-987-6543 now") == "call <PHONE> <PHONE> now"
    assert shown("555-123-4567,555-987-6543") == "<PHONE>,<PHONE>"
    assert shown("pay 4111/1111/1111/1111 4111/1111/1111/1111") == "pay <CARD> <CARD>"
    assert shown("2001-02-03 2004-05-06") == "2001-02-03 2004-05-06"
    many = " ".join(["anna [at] mail [dot] org"] * 40)
    assert "[at]" not in shown(many)
    whole = total = 0
    for _ in range(300):
        made, say = rng.choice([(phone, "<PHONE>"), (card, "<CARD>")])
        n, by = rng.randint(2, 6), rng.choice([" ", ", ", "; ", "\n"])
        got = shown("reach me " + by.join(made() for _ in range(n)) + " before noon")
        whole, total = whole + got.count(say), total + n
    assert whole / total > 0.98, (whole, total)


def test_viterbi_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    f = pii.Field({}, np.zeros((0, 5)), rng.normal(size=(5, 5)))
    e = rng.normal(size=(6, 4, 5))
    n = np.array([4, 3, 1, 4, 2, 4])
    got = f.viterbi(e, n)
    for s in range(6):
        best = max(itertools.product(range(5), repeat=n[s]), key=lambda p: sum(e[s, t, y] for t, y in enumerate(p)) + sum(f.steps[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[s, : n[s]]) == best


# ---- 5 -----------------------------------------------------------------------


def test_pieces(docs, rows, none):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pieces(docs, capacity=64).collect()
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        k = -(-len(ids) // 64)
        cuts = [0, *range(len(ids) - 64 * (k - 1), len(ids) + 1, 64)] if k > 1 else [0, len(ids)]
        want += [(r[0], p, a, b - a, np.array(ids[a:b], dtype="<u4").tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    same([(*tuple(r)[:4], bytes(r["ids"])) for r in got], want)
    assert packing.pieces(none).count() == 0


def test_ids_fuzz():
    t, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(2)
    e = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    parts = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "é", "中", "😀", "\0", "'s", "'LL", "1", "٣", "½", "_", "\u3000", "\u200b", "<|endoftext|>", ".", "\x85", "\x1c", "ß", "\u0301"]
    for _ in range(3000):
        x = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert t.encode(x, add_special_tokens=False).ids == e.ids(x).tolist(), repr(x)


def test_pack(docs, none, rows):
    pieces = packing.pieces(docs, capacity=64)
    got = packing.pack(clashing(pieces), 64).select("doc_id", "piece", "ids", "length", "sequence_id", "offset").collect()
    assert len(got) == pieces.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for s in by.values():
        at = 0
        for offset, length, _ in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    counts = np.bincount([r["length"] for r in got], minlength=65)
    assert len(by) == sum(n for _, n in packing.plan(counts, 64)) <= sum(n for _, n in packing.best_fit_decreasing(counts, 64))
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packing.pack(pieces, 64)).collect()}
    assert sorted(len(x) for x in whole.values()) == sorted(4 * sum(p[1] for p in s) for s in by.values())
    assert packing.pack(packing.pieces(none)).count() == 0


def least_bins(sizes: list[int], capacity: int) -> int:
    """By exhaustive search."""
    best = len(sizes)

    def place(i: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best and i < len(sizes):
            return
        if i == len(sizes):
            best = min(best, len(bins))
            return
        for j in {b: k for k, b in enumerate(bins) if b + sizes[i] <= capacity}.values():
            place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_least(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, rng.choice([10, 20, 30])) for _ in range(rng.randint(0, 9))), reverse=True)
    counts = np.bincount(sizes, minlength=31)
    plan = packing.plan(counts, 30)
    used = np.zeros(31, dtype=int)
    for items, n in plan:
        assert sum(items) <= 30
        for s in items:
            used[s] += n
    assert (used == counts).all()
    assert packing.lower_bound(counts, 30) <= least_bins(sizes, 30) == sum(n for _, n in plan)


def test_plan_goes_on_to_all_fillings():
    """Middle lengths whose least plan needs a filling that is not promising, or one used less often than it could be."""
    cases = [
        (100, 9, {22: 4, 23: 4, 27: 6, 50: 11}), (60, 5, {12: 5, 14: 7, 19: 5, 22: 2}), (100, 10, {24: 9, 27: 6, 33: 12, 43: 5}),
        (60, 6, {16: 3, 17: 9, 25: 6}), (100, 8, {26: 5, 28: 5, 33: 6, 44: 7}),
    ]
    for capacity, least, pieces in cases:
        counts = np.bincount([s for s, n in pieces.items() for _ in range(n)], minlength=capacity + 1)
        got = packing.plan(counts, capacity)
        assert sum(n for _, n in got) == least
        assert (sum(np.bincount(items, minlength=capacity + 1) * n for items, n in got) == counts).all()


def test_maximal_fillings():
    import itertools

    rng = random.Random(2)
    for _ in range(200):
        free, pieces = rng.randint(0, 30), sorted(rng.choices(range(1, 15), k=rng.randint(0, 8)), reverse=True)
        sets = {c for n in range(len(pieces) + 1) for c in itertools.combinations(pieces, n) if sum(c) <= free}
        left = {c: [s for s in set(pieces) if pieces.count(s) > c.count(s)] for c in sets}
        want = sorted(c for c in sets if all(sum(c) + s > free for s in left[c]))
        counts = np.bincount(pieces, minlength=31) if pieces else np.zeros(31, dtype=int)
        assert sorted(f for f in packing.maximal(counts, free) if f is not None) == want


# ---- 6 -----------------------------------------------------------------------


def nearest(table, ids, k):
    out = []
    good = [(i, np.array(v, dtype=float)) for i, v in table if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for q, v in good:
        if q in ids:
            out += [(q, r, i) for r, (_, i) in enumerate(sorted((-float(v @ w), i) for i, w in good if i != q)[:k], 1)]
    return out


def test_neighbours_exact_when_small(spark):
    rng = np.random.default_rng(1)
    table = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    table += [(i, table[5][1]) for i in range(200, 260)]  # one vector that many rows have
    table += [(300, None), (301, [0.0] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] + [1.0] * 7), (304, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (305, [])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), k=5).collect()
    want = nearest(table, {i for i, _ in table if i is not None and i % 20 == 0}, 5)
    same([(r["query_id"], r["rank"], r["vec_id"]) for r in got], want)
    few = df.where("vec_id < 3")
    assert neighbours.search(few, few, k=5).count() == 6
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    table = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(6000)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").cache()
    got = neighbours.search(df, df.where("vec_id % 50 = 0"), k=10, block=1500)
    v = np.array([x for _, x in table])
    hits = 0
    for r in got.collect():
        s = v @ v[r["query_id"]]
        s[r["query_id"]] = -np.inf
        hits += s[r["vec_id"]] >= np.sort(s)[-10]
        assert r["score"] == pytest.approx(s[r["vec_id"]], abs=1e-12)
    assert hits / (120 * 10) >= 0.9


# ---- 7 -----------------------------------------------------------------------


def plain_counts(t):
    w = WORD(t)
    lines = [x for x in t.split("\n") if WORD(x)]
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if tri[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows, none):
    got = quality.judge(clashing(docs)).select("doc_id", *quality.COUNTS, "base_failed").collect()
    want = []
    for r in rows:
        c = plain_counts(r[1] or "")
        want.append((r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    same([tuple(r) for r in got], want)
    assert quality.judge(none).count() == 0


def test_quality_counts_fuzz(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b", " ", "\n", "\t", "#", "é", " a b c", "\x0b", "\u3000", "\r"], k=rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.counted(df).select("doc_id", *quality.COUNTS).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_counts(t), repr(t)


def test_quality_separates(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 120), 1) for i in range(200)]
    rows += [(1000 + i, " | ".join("".join(rng.choices("bcdfg", k=9)) for _ in range(80)), 0) for i in range(15)]
    rows += [(2000 + i, prose(rng, 100).upper().replace(" ", "!! "), 0) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good int")
    out = quality.judge(df).select("good", "kept", "p_good").collect()
    assert all(bool(r["good"]) == r["kept"] for r in out)
    assert quality.judge(df).select("kept").explain() is None


def test_quality_fit_by_hand(spark):
    """The estimates against the same steps in plain Python."""
    import math

    rng = random.Random(6)
    votes = [tuple(rng.choices((-1, 0, 1), w)[0] for _ in range(3)) for w in [(1, 2, 8)] * 300 + [(8, 2, 2)] * 60]
    n = collections.Counter(votes)
    df = spark.createDataFrame([(*v, c) for v, c in n.items()], "a int, b int, c int, n long")
    share, theta = quality.fit(df, ["a", "b", "c"])
    p, t = quality.PRIOR_BAD, {y: [list(quality.PRIOR[y]) for _ in range(3)] for y in quality.PRIOR}
    total, weight = sum(n.values()), quality.STRENGTH * sum(n.values())
    for _ in range(quality.ROUNDS):
        q = {v: 1 / (1 + math.exp(-(math.log(p / (1 - p)) + sum(math.log(t["bad"][j][x + 1] / t["good"][j][x + 1]) for j, x in enumerate(v))))) for v in n}
        bad = sum(n[v] * q[v] for v in n)
        new = {y: [[(sum(n[v] * (q[v] if y == "bad" else 1 - q[v]) for v in n if v[j] == x) + weight * quality.PRIOR[y][x + 1]) / ((bad if y == "bad" else total - bad) + weight) for x in (-1, 0, 1)] for j in range(3)] for y in t}
        moved = max(abs(a - b) for y in t for r, s in zip(new[y], t[y]) for a, b in zip(r, s))
        p, t = (bad + weight * quality.PRIOR_BAD) / (total + weight), new
        if moved < quality.TOLERANCE:
            break
    assert share == pytest.approx(p, rel=1e-9)
    for y in t:
        assert np.allclose(theta[y], t[y])


# ---- 8 -----------------------------------------------------------------------


def plain_mix(rows, weights=(5, 2, 1), share=1.5, cap=2.0, seed=8):
    size = [len(WORD(r[1] or "")) for r in rows]
    total = collections.Counter()
    for r, n in zip(rows, size):
        total[r[3]] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(size), list(order), {}
    while True:
        each = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if each * w[s] > cap * total[s]]
        if not over:
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: each * w[s] for s in open_}
    out = []
    for s in order:
        copies = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - copies * total[s]
        by = collections.defaultdict(list)
        for i, r in enumerate(rows):
            if r[3] == s:
                h = hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:15]
                by[h].append(i)
        gone, go = 0, True
        for h in sorted(by):
            own = sum(size[i] for i in by[h])
            if go and own and not gone + own <= rest:
                take, go = gone + own - rest < rest - gone, False
            else:
                take = go
            for i in by[h]:
                out.append((rows[i][0], size[i], total[s], round(target[s], 6), (copies + take) * size[i]))
            gone += own
    return out


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (1, 50)])
def test_mix(docs, rows, weights):
    got = mixing.mix(clashing(docs), weights).collect()
    same([(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"] * r["size"]) for r in got], plain_mix(rows, weights))
    again = mixing.mix(docs.repartition(5), weights)
    same([(r["doc_id"], r["text"], r["copies"]) for r in got], [(r["doc_id"], r["text"], r["copies"]) for r in again.collect()])
    assert mixing.repeated(again).count() == sum(r["copies"] for r in got)
    assert mixing.repeated(again).columns == docs.columns


def test_mix_levels(spark):
    """Enough rows in one source that the boundary is refined more than once."""
    rows = [(i, "w " * (i % 5), None, "s" if i % 7 else "t", 0) for i in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "copies").collect()
    same([(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"] * r["size"]) for r in got], plain_mix(rows))


def test_mix_empty(none):
    assert mixing.mix(none).count() == 0


# ---- 9 -----------------------------------------------------------------------


def plain_components(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out += [(rows[i][0], len(sets[i]), least if sets[i] else rows[i][0]) for i in g]
    return out, groups, sets


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice("pqrstu") * 3
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_jaccard(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 4)
    rng = random.Random(seed)
    texts = [r[1] for r in awkward(seed)]
    for n, edits in ((30, 1), (20, 3), (25, 6), (12, 9)):  # families around the threshold
        texts += family(rng, prose(rng, 120), n, edits)
    passage = prose(rng, 60)
    texts += [passage + " " + prose(rng, rng.randint(1, 80)) for _ in range(30)]
    texts += ["A b C d", "a B c d", "a b c", "same words only five here", "same words only five here"]
    rng.shuffle(texts)
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, groups, sets = plain_components(rows)
    same([tuple(r) for r in jaccard.link(df).collect()], want)
    kept = jaccard.keep_one(df.selectExpr("doc_id", "text", "1 AS component_id")).collect()
    assert len(kept) == sum(1 if sets[g[0]] else len(g) for g in groups.values())


def test_jaccard_empty(none, spark):
    assert jaccard.link(none).count() == 0 and jaccard.keep_one(none).count() == 0
    blank = spark.createDataFrame([(1, None), (1, ""), (None, " ")], "doc_id long, text string")
    same([tuple(r) for r in jaccard.link(blank).collect()], [(1, 0, 1), (1, 0, 1), (None, 0, None)])
    assert jaccard.keep_one(blank).count() == 3


def test_roots(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(60)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in jaccard.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(201)}) == 1
    for a, b in edges:
        assert got.get(a) == got.get(b)
    assert len({got[i] for i in got}) == len({frozenset(k for k in got if got[k] == got[i]) for i in got})


# ---- 10 ----------------------------------------------------------------------

VOICES = {"aa": "kala mena tolu risa penu wako", "bb": "strix brond krelt vomps grund tschek", "cc": "ouie eaux oiere teaux ueil aient"}


def voice(rng, lang, n):
    parts = VOICES[lang].split()
    return " ".join(rng.choice(parts) + rng.choice(parts)[:3] for _ in range(n))


def test_langid(spark):
    rng = random.Random(1)
    rows = [(i, voice(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choices(list(VOICES), (5, 2, 1), k=300))]
    rows += [(900, None, "aa"), (901, "12 34 !?", "aa"), (902, "", None), (903, voice(rng, "bb", 30).upper(), None), (None, voice(rng, "cc", 20000), None), (5, rows[5][1], None)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    held = langid.held_out()
    learned = langid.learn(df.where(~held))
    assert set(learned) == set(VOICES) and list(learned)[0] == "aa" and all(len(x) <= langid.DICT_BYTES for x in learned.values())
    out = langid.identify(df.withColumn("held", held), learned).collect()
    test = [r for r in out if r["held"] and r["lang"] and r["lang_pred"] != "und"]
    assert len(test) > 40 and sum(r["lang"] == r["lang_pred"] for r in test) / len(test) > 0.97
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[900]["rejected"] and by[900]["score"] == 0
    assert by[903]["lang_pred"] == "bb" and by[None]["lang_pred"] == "cc" and all(0 <= r["score"] <= 1 for r in out)
    for r in out:
        assert r["held"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)


def test_langid_learns_nothing(spark, docs, none):
    assert langid.learn(none) == {} and langid.identify(none, {}).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}


# ---- rows that are hard to spread, limits that are none, names that clash ---------


def test_mix_takes_some_of_equal_rows(spark):
    """Rows that nothing tells apart are not one block: the words taken come near the target."""
    rows = [(None, "same old words in each row", None, "s", 0)] * 500 + [(i, "w " * (i % 9), None, "s" if i % 2 else "t", 0) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = mixing.mix(df).groupBy("source").agg({"target": "max", "copies": "max"}).collect()
    taken = {r["source"]: r["t"] for r in mixing.mix(df).selectExpr("source", "copies * size AS c").groupBy("source").agg({"c": "sum"}).withColumnRenamed("sum(c)", "t").collect()}
    for r in out:
        assert abs(taken[r["source"]] - r["max(target)"]) <= 6 and r["max(copies)"] <= 2


def test_mix_empty_texts_stay_within_the_cap(spark):
    df = spark.createDataFrame([(i, "" if i % 2 else "two words", None, "a" if i % 3 else "b", 0) for i in range(300)], SCHEMA)
    assert max(r["copies"] for r in mixing.mix(df, (50, 1)).collect()) <= 2


def test_sharding_spreads_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ALIKE", 50)
    df = spark.createDataFrame([(1, "same")] * 2000 + [(i, f"t{i}") for i in range(2000)], "doc_id long, text string").repartition(6)
    out = sharding.external_shuffle(df, 8, buckets=40).select("shard", "slot", "text").collect()
    counts = collections.Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(out) == 4000
    same_in = collections.Counter(r["shard"] for r in out if r["text"] == "same")
    assert max(same_in.values()) < 450  # of 500 rows in a shard; one bucket would fill shards


def test_sharding_columns_by_brute_force(spark):
    """The query's digest columns, and its permutation, against plain Python."""
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in __spark_entry__.queries()["op2_external_shuffle"](spark, sf).collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    same([(g[0], g[1], g[2], g[3], g[6]) for g in got], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in docs])
    hashed = spark.read.parquet(f"{sf}/documents.parquet")
    hashes = {r[0]: r[1] for r in hashed.select("doc_id", sharding.row_hash(hashed, 2017)).collect()}
    total = hashed.agg({"*": "count"}).first()[0]
    n = sharding.bucket_count(hashed.agg(sharding.F.sum(sharding.row_bytes(hashed))).first()[0])
    order = []
    for b in range(n):
        ids = [i for i in hashes if hashes[i] % n == b]
        ids.sort(key=lambda i: hashes[i])
        h = np.array([hashes[i] for i in ids], dtype=np.int64)
        order += [ids[j] for j in sharding.fisher_yates(2017, b, h)]
    shard = {i: k * 8 // total for k, i in enumerate(order)}
    first = {s: -(-s * total // 8) for s in range(8)}
    assert {(g[0], g[4], g[5]) for g in got} == {(i, shard[i], k - first[shard[i]]) for k, i in enumerate(order)}


def test_sharding_with_maps(spark):
    df = spark.createDataFrame([(1, "t", {"a": i}) for i in range(40)], "doc_id long, text string, m map<string,int>")
    assert len({r[0] for r in df.select(sharding.row_hash(df, 1)).collect()}) == 40
    assert sharding.external_shuffle(df, 4).count() == 40


def test_langid_leaves_no_language_out(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcdefgh", k=30)), f"l{i % 700:03}") for i in range(2100)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(learned) == 700 and all(learned.values()) and sum(map(len, learned.values())) <= langid.ALL_BYTES


def test_langid_reads_whole_texts(spark):
    """What tells the language may stand anywhere in a text."""
    rng = random.Random(5)
    rows = [(i, "x" * 3000 + " " + voice(rng, "aa" if i % 2 else "bb", 400), "aa" if i % 2 else "bb") for i in range(200)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = langid.Classifier(learned)
    assert all(model.predict(voice(rng, v, 20))[0] == v for v in ("aa", "bb") for _ in range(20))


def test_langid_by_plain_zstandard(spark):
    import zstandard

    rng = random.Random(6)
    contents = {k: " ".join(voice(rng, k, 300) for _ in range(3)).encode() for k in VOICES}
    texts = [voice(rng, rng.choice(list(VOICES)), rng.randint(1, 40)) for _ in range(150)] + ["²³ ½ 12", "", "Ⅷ", "A"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, contents).collect()}
    for i, t in enumerate(texts):
        if not any(c.isalpha() for c in t):
            assert got[i] == ("und", 0.0)
            continue
        sizes = []
        for k in contents:
            d = zstandard.ZstdCompressionDict(contents[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=langid.LEVEL)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False).compress(f" {t.lower()} ".encode())))
        first, second = sorted(sizes)[:2]
        assert got[i] == (list(contents)[sizes.index(first)], (second - first) / second)


def test_pii_inside_long_tokens():
    field = pii.train(pii.labelled_table())

    def shown(text):
        base, more = next(pii.spans_of([text], field, field.gap(), {}))
        return pii.masked(text, base + more)

    assert shown("a" * 100 + "?card=4111/1111/1111/1111") == "a" * 100 + "?card=<CARD>"
    assert shown("q" * 90 + "|(555)123-4567|" + "z" * 90) == "q" * 90 + "|<PHONE>|" + "z" * 90
    assert shown("call 555-123-4567/555-987-6543 now") == "call <PHONE>/<PHONE> now"
    assert shown("host 10[.]2[.]3[.]4 up") == "host <IP> up" and shown("at 10 [dot] 2 [dot] 3 [dot] 4.") == "at <IP>."
    assert shown("see 300[.]2[.]3[.]4") == "see 300[.]2[.]3[.]4"
    for text in ("9" * 200, "aB3/" * 50, "-" * 500, "[1] [2] [3]", "http://example.com/" + "a/b1/" * 30 + "2001-02-03"):
        assert shown(text) == text


def test_jaccard_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two three four five", "x"), (2, "One two three four five", "y")], "doc_id long, text string, v string")
    df = df.selectExpr("*", "v AS text_hash", "v AS KEPT_ID", "v AS kept_hash", "v AS component")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "one two three four five", *"xxxxx")]


def test_roots_of_a_long_path_take_few_rounds(spark, monkeypatch):
    from polymetric.operators import contraction

    n, seen = 5000, []
    plain = contraction.written
    monkeypatch.setattr(contraction, "written", lambda df, name: seen.append(name) or plain(df, name))
    got = contraction.roots(spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")).collect()
    assert len(got) == n and len({r["root"] for r in got}) == 1 and seen.count("parents") <= 10
