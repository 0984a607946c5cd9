"""Each operator against a brute-force version, a library or held-out labels."""

import base64
import hashlib
import io
import random
import re
import zipfile
from collections import Counter

import pytest

from tests.conftest import SF
from versewright.llm import chat_format as chat
from versewright.llm import decontamination, near_dedup, piece_codec, quality_rules, secret_scan, substring_dedup, token_counts, weak_labels, zip_warc
from versewright.llm.common import components
from versewright.llm.queries import MODEL
from versewright.llm.shingles import word_hashes

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(MODEL)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


class Sets:
    def __init__(self, ids):
        self.root = {i: i for i in ids}

    def find(self, x):
        while self.root[x] != x:
            x = self.root[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    s = Sets({x for e in edges for x in e})
    for a, b in edges:
        s.join(a, b)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: s.find(x) for a, b in edges if a != b for x in (a, b)}


def test_tokens_against_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(1)
    pool = list("abcdeinrst .,-=_0123ABCéß日😀\n▁\t")
    some = list(texts.values()) + ["", " ", "▁▁ a", "<s>x</s><unk><0x0A>", "-" * 3000, "=" * 333 + "a" * 900, " " * 300 + "x", "the" * 400, "x́" * 20]
    some += ["".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 120))) for _ in range(800)]
    want = sp.encode(some, num_threads=1)
    assert token_counts.counter(PATH).count(some) == [len(x) for x in want]
    c = piece_codec.codec(PATH)
    assert [c.encode(t) for t in some] == want
    assert [c.decode(x) for x in want] == [sp.decode(x) for x in want]


def test_token_queries(spark, docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in piece_codec.round_trip(docs, PATH).collect():
        ids = sp.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    for r in token_counts.token_counts(docs, PATH).collect():
        assert (r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), len(sp.encode(texts[r["doc_id"]])))


def _words(t):
    return word_hashes((t or "").lower().split())


def _linked(texts):
    """Classes by brute force: all pairs of texts, compared word by word."""
    w, s = {i: _words(t) for i, t in texts.items()}, Sets(texts)
    ids, pairs = sorted(texts), 0
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if texts[i] == texts[j] or (min(len(w[i]), len(w[j])) >= 0.8 * max(len(w[i]), len(w[j])) and near_dedup.similar(w[i], w[j])):
                s.join(i, j)
                pairs += 1
    return {i: s.find(i) for i in ids}, pairs


def test_near_dedup(docs, texts):
    want, _ = _linked(texts)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert all(want[i] == want[c] for i, c in got.items())  # nothing but what is linked
    assert sum(got[i] == want[i] for i in want if want[i] != i) >= 0.95 * sum(want[i] != i for i in want)


def test_recall_of_near_copies(spark):
    """Copies with words changed, put in, left out and moved, down to the least similarity."""
    rnd = random.Random(9)
    prose = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    rows = {}
    for k in range(150):
        a = prose(rnd.choice((30, 80, 200, 500)))
        b = list(a)
        for _ in range(max(1, int(len(a) * rnd.choice((0.01, 0.03, 0.06, 0.09))))):
            at = rnd.randrange(len(b))
            b[at : at + 1] = rnd.choice(([], [f"n{rnd.randrange(10**6)}"], [f"n{rnd.randrange(10**6)}", b[at]]))
        rows |= {2 * k: " ".join(a), 2 * k + 1: " ".join(b)}
    want, pairs = _linked(rows)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    linked = [i for i in want if want[i] != i]
    assert pairs >= 130 and sum(got[i] == want[i] for i in linked) >= 0.97 * len(linked)
    assert all(want[i] == want[c] for i, c in got.items())


def test_alignment_is_exact():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(300):
        a = [rnd.randrange(12) for _ in range(rnd.randrange(5, 40))]
        b = [x for x in a if rnd.random() > 0.1] + [rnd.randrange(12) for _ in range(rnd.randrange(3))]
        rnd.random() < 0.3 and b.reverse()
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        lcs = t[-1][-1]
        assert near_dedup.similar(np.array(a, np.uint64), np.array(b, np.uint64)) == (lcs / (len(a) + len(b) - lcs) >= 0.8 - 1e-12)


@pytest.mark.parametrize("n", [150, 1500])
def test_hot_group_of_near_copies(spark, n):
    """All copies of one text, edited, come to one class; pairs grow with the members, not with their square."""
    from versewright.llm import common

    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rnd.shuffle(rows)
    rows = [((i * 7919) % 100_003, t) for i, t in rows]  # the original is not the smallest id
    counts, keep = [], common.stored

    def stored(df, name):
        t = keep(df, name)
        if name == "pairs":
            counts.append(t.count())
        return t

    common.stored = stored
    try:
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        common.stored = keep
    if n == 150:
        want, _ = _linked(dict(rows))
        assert len(set(want.values())) == 1
    assert len(set(got.values())) == 1 and sum(counts) <= 6 * n


def test_contamination(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: [x for x in re.sub(r"[\W_]+", " ", t.lower()).split() if x]
    sh = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    items = {r["item_id"]: words(r["text"]) for r in bench.collect()}
    extra = spark.createDataFrame([(10_000 + i, "start here " + " ".join(w[: n // 2] + ["changed"] * c + w[n // 2 + c :]) + " end") for i, w in items.items() for n in [len(w)] for c in (0, 1)], "doc_id long, text string")
    all_ = docs.select("doc_id", "text").unionByName(extra)
    want = set()
    for r in all_.collect():
        w = words(r["text"])
        have = set(sh(w))
        for i, x in items.items():
            b = sh(x)
            if have & set(b):
                for s in range(len(w) - len(x) + 1):
                    a = sh(w[s : s + len(x)])
                    n = sum((a & b).values())
                    if n >= 0.8 * (sum(a.values()) + sum(b.values()) - n):
                        want.add((r["doc_id"], i))
                        break
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(all_, bench).collect()} == want


def test_quality_measures(docs, texts):
    for r in quality_rules.verdicts(docs).collect():
        t = texts[r["doc_id"]]
        w = re.findall(r"[^ \t-\r]+", t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^ \t-\r]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_ablation(docs):
    d = quality_rules.ledger(docs).cache()
    bits = [r["fail_bits"] for r in d.select("fail_bits").collect()]
    for r in quality_rules.ablation(d).collect():
        policy = {"base": quality_rules.BASE, "v1": quality_rules.STRICT, "v2": quality_rules.LAYOUT}[r["policy"]]
        m, one = quality_rules.mask(policy), quality_rules.mask(quality_rules.Policy("", (r["rule"],)))
        assert (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) == (sum(b & one != 0 for b in bits), sum(b & m == one for b in bits), sum(b & m & ~one == 0 for b in bits))


def test_secrets(spark, docs, texts):
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    rnd = random.Random(4)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rnd.choice(chars) for _ in range(32)) for _ in range(200)]
    plain = ["internationalization2", "authentication_handler_v2", "thReadingTheStationOver"] * 20
    d = spark.createDataFrame([(10_000 + i, f"see {k} here") for i, k in enumerate(keys)] + [(20_000 + i, f"see {k} here") for i, k in enumerate(plain)] + [(30_000, "token: token: abcdefgh secret=ab api_key='abcdef' xAKIA" + "B" * 16)], "doc_id long, text string")
    all_ = docs.select("doc_id", "text").unionByName(d)
    found = {r["doc_id"]: r for r in secret_scan.report(all_, model).collect()}
    for r in all_.collect():
        spans = []
        for k, (kind, pattern, group, least) in enumerate((("assign", secret_scan.ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, r["text"]) if len(m.group(group)) >= least]
        assert found[r["doc_id"]]["base_sha256"] == hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest()
    assert sum("markov" in found[10_000 + i]["spans"] for i in range(200)) >= 190
    assert sum("markov" in found[20_000 + i]["spans"] for i in range(60)) == 0


def test_chat_costs_are_least():
    rnd = random.Random(6)
    for _ in range(200):
        roles = [rnd.choice([0, 1, 2, -1]) for _ in range(rnd.randrange(0, 6))]
        ends = [chat.ending(s)[0] for s in chat.STATES]
        best = chat.rest_costs(roles, ends)[0][chat.STATES.index(chat.START)]
        todo, least = [(0, chat.START, 0)], 10**9  # every sequence of moves
        while todo:
            i, s, c = todo.pop()
            if i == len(roles):
                least = min(least, c + ends[s])
                continue
            todo += [(i + 1, m[1], c + m[0]) for m in chat.moves(s, roles[i])]
        assert best == least
        chosen, last = chat.choose(roles, ends, chat.START)
        seq = [x for a, r, put in chosen for x in (*put, *([] if "merge" in a else [r]))] + list(chat.ending(last)[1])
        assert seq == [] or (all(b in chat.NEXT[a] for a, b in zip([chat.START] + seq, seq)) and seq[-1] == chat.FINAL)


def test_long_conversation_over_partitions(spark):
    rnd = random.Random(1)
    rows = [(7, i, rnd.choice(["user", "assistant", "system", "bot", None]), f"t{i}") for i in range(400)] + [(i, 0, "user", "x") for i in range(20, 40)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, chat.repaired(t, 1).collect())) == sorted(map(str, chat.repaired(t, 12).collect()))


def test_archives(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows, first = pages.collect(), {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault(r["html"], r["page_id"])
    want = {(r["page_id"], len(r["html"].encode()), base64.b32encode(hashlib.sha1(r["html"].encode()).digest()).decode(), "response" if first[r["html"]] == r["page_id"] else "revisit", None if first[r["html"]] == r["page_id"] else first[r["html"]]) for r in rows}
    assert set(map(tuple, zip_warc.round_trip(pages).collect())) == want


@pytest.mark.parametrize("zip64", [False, True])
def test_zip(zip64):
    raw = b"".join(zip_warc.zip_file([("a", b"xyz" * 10), ("b/c", b""), ("d", b"Q")], zip64))
    z = zip_warc.ZipReader(lambda o, n: raw[o : o + n], len(raw))
    for name, data in (("a", b"xyz" * 10), ("b/c", b""), ("d", b"Q")):
        o, n = z.place(name)
        assert raw[o : o + n] == data
    assert zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("packed", "p" * 100)
        f.comment = b"PK\5\6 not the end"
    raw = other.getvalue()
    with pytest.raises(ValueError, match="not stored"):
        zip_warc.ZipReader(lambda o, n: raw[o : o + n], len(raw)).place("packed")
    with pytest.raises(ValueError, match="not a ZIP"):
        zip_warc.ZipReader(lambda o, n: b"none"[o : o + n], 4)


def test_weak_labels_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    kept = {r["doc_id"]: r["kept"] for r in weak_labels.scored(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    lab = spark.read.parquet(f"{sf}/labels.parquet").collect()  # no label is seen in training
    good = [kept[r["doc_id"]] for r in lab if r["quality"] == 1]
    bad = [kept[r["doc_id"]] for r in lab if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.25


def test_estimation_finds_accuracies():
    rnd = random.Random(8)
    n = Counter()
    for _ in range(20_000):
        good = rnd.random() < 0.8
        n["".join("-" if rnd.random() < 0.2 else "gb"[(rnd.random() < a) != good] for a in (0.95, 0.9, 0.85, 0.8))] += 1
    acc, share, _ = weak_labels.estimate(dict(n))
    assert abs(share - 0.8) < 0.03 and all(abs(x["g"][0] / (x["g"][0] + x["b"][0]) - a) < 0.03 for x, a in zip(acc, (0.95, 0.9, 0.85, 0.8)))
