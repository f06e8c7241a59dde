"""Whole tables against plain Python."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from scholia.llm import bpe, fingerprint, neardup, queries, secret_scan
from tests.compare import compare
from tests.conftest import SF


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall())


@pytest.fixture(scope="module")
def library():
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in queries.QUERIES[name](spark, SF).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints(spark, texts):
    got, order = rows(spark, "op1_fingerprints"), sorted(texts)
    assert set(got) == set(order)
    for i, d in enumerate(order):
        t, n = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        assert r["near_next"] == fingerprint.likeness(r["fingerprint"], got[order[(i + 1) % len(order)]]["fingerprint"])
    by = collections.defaultdict(set)
    for d in order:
        by[texts[d]].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in by.values())
    near = [r["near_edited"] for r in got.values()]
    assert np.mean(near) > 10 * np.mean([r["near_next"] for r in got.values()])


def test_document_frequencies(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {bytes(r["term"]): r["df"] for r in fingerprint.document_frequencies(docs).collect()}
    assert got == collections.Counter(w for t in texts.values() for w in fingerprint.terms(t))


def test_decontamination(spark, con, texts):
    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = collections.defaultdict(set)
    for i, t in con.execute("select item_id, text from benchmark").fetchall():
        w = find(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1):
            windows[tuple(w[k:k + n])].add(i)
    hits = 0
    for d, r in rows(spark, "op2_decontamination").items():
        w, hit, items = find(low(texts[d])), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k:k + n])]
        hits += len(hit)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == sha(",".join(sorted(map(str, items))))
    assert hits


def test_lengths(spark, texts, library):
    own = [len(library.encode_ordinary(t)) for t in texts.values()]
    got = rows(spark, "op3_token_lengths", "n_tokens")
    assert {n: r["n_docs"] for n, r in got.items()} == collections.Counter(own)
    assert all(r["kept_tokens"] == sum(min(x, n) for x in own) for n, r in got.items())


def test_counts_of_odd_texts(library):
    with open(bpe.RANKS, "rb") as f:
        e = bpe.Encoder(f.read(), public_tokenizers.PATTERN)
    odd = ["", " ", "a", "  a", "a ", "a  b", "a\n b c", " a b", "\u00a0 x y", "x\u3000 y z", "y " + "z" * 70 + " y", "q" * 200, "don't stop 12345 é\u0301 b", "a b\n", "a b \n c"]
    for _ in range(2):  # unknown words, then remembered ones
        assert [e.count(t) for t in odd] == [len(library.encode_ordinary(t)) for t in odd]


def test_shards(spark, texts):
    got = rows(spark, "op4_shards")
    assert set(got) == set(texts)
    by = collections.defaultdict(list)
    for d, r in got.items():
        assert (r["size"], r["text_crc32"]) == (len(texts[d].encode()) + 1, zlib.crc32(texts[d].encode()))
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(map(len, by.values())) <= {12, 13} and len(by) == 16


def test_bpe(spark, texts, library):
    for d, r in rows(spark, "op5_bpe_round_trip").items():
        ids = library.encode_ordinary(texts[d])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[d]))


def test_bpe_on_odd_texts(library):
    with open(bpe.RANKS, "rb") as f:
        encoder = bpe.Encoder(f.read(), public_tokenizers.PATTERN)
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("ab aé日🙂\x00 \n\t12'sZ 　\xa0\r") for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == library.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()
    for text in ("a" * 5000, " " * 3000, "ab" * 4000, "\n" * 999 + "x", " a" * 3000):
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_bpe_of_many_texts(library, monkeypatch):
    """All pieces of a span are encoded together: as many steps as the longest has bytes, however many words; cut anywhere, as the library says."""
    with open(bpe.RANKS, "rb") as f:
        e = bpe.Encoder(f.read(), public_tokenizers.PATTERN)

    def ids(texts):
        out = [[] for _ in texts]
        for of, found, ends in e.spans(pa.array([None, *texts], pa.string())[1:]):
            for i, a, b in zip(of, ends, ends[1:]):
                out[i] += found[a:b].tolist()
        return out

    rng = random.Random(7)
    odd = ["".join(rng.choice("ab aé日🙂\x00 \n\t12'sZ \u3000\xa0\r\u2003ɐȿ\u0301\x1c\x85l've.,!ÀÉ߀") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    odd += ["a" * 5000, " " * 3000, "ab" * 4000, "\n" * 999 + "x", " a" * 3000, "", " ", "  a", "a ", "don't 've", "日本 x y", "x" * 64, "x" * 65, "é" * 33]
    want = [library.encode_ordinary(t) for t in odd]
    for span in (1, 7, 50, bpe.SPAN):
        monkeypatch.setattr(bpe, "SPAN", span)
        assert ids(odd) == want
    assert ids([]) == [] and list(map(len, ids(["", ""]))) == [0, 0]
    steps, fits = [], bpe.Tables.fits
    monkeypatch.setattr(bpe.Tables, "fits", lambda self, left, right: steps.append(len(left)) or fits(self, left, right))
    words = ["".join(rng.choice("bcdfghjkqvxz") for _ in range(rng.randint(6, 15))) for _ in range(3000)]
    assert ids([" ".join(words)]) == [library.encode_ordinary(" ".join(words))]
    assert len(steps) <= 16 and sum(steps) > 3000
    other = bpe.Encoder(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in e.vocabulary.rank.items()), r"\p{L}+|\s")
    assert [found.tolist() for _, found, _ in other.spans(pa.array(["ab c", "", None]))] == [other.encode("ab c"), [], []]


def test_bpe_edits():
    with open(bpe.RANKS, "rb") as f:
        vocabulary = bpe.Vocabulary(f.read())
    rng = random.Random(6)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdetionr") for _ in range(rng.randint(0, 300)))
        a = rng.randint(0, len(piece))
        b, new = rng.randint(a, min(len(piece), a + 5)), bytes(rng.choice(b"abcdetionr") for _ in range(rng.randint(0, 5)))
        table, whole = bpe.Prefixes(vocabulary, piece), bpe.Prefixes(vocabulary, piece[:a] + new + piece[b:])
        table.replace(a, b, new)
        assert table.last == whole.last and table.ids() == whole.ids()
        head = bpe.Prefixes(vocabulary, piece[:a])
        head.append(piece[a:])
        assert head.last == bpe.Prefixes(vocabulary, piece).last and head.ids(a) == bpe.Prefixes(vocabulary, piece[:a]).ids()


def test_chat(spark, con):
    said = "</s>[INST] ok [/INST]"
    turns = con.execute("select conv_id, turn, coalesce(role, ''), coalesce(text, '') from conversations order by 1, 2, 3, 4").fetchall()
    by = collections.defaultdict(list)
    for c, _, role, text in [*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        by[c].append((role, text))
    got = rows(spark, "op6_chat", "conv_id")
    assert set(got) == set(by)
    for c, own in by.items():
        learnt = "".join(t for r, t in own if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(learnt)) and r["loss_sha256"] == sha(learnt)
        assert r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in own))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, SF, queries.QUERIES[name], queries.ORACLES[name]) == ""


def test_secrets(spark, texts):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for d, r in rows(spark, "op8_secret_scan").items():
        t, found = texts[d], []
        found += [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        told = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert r["base_sha256"] == sha(told)
        assert [s for s in r["spans"].split(",") if s and not s.startswith("random")] == [s for s in told.split(",") if s]
        # Card-like numbers are nobody's secret, whatever the models were trained on.
        assert not [s for s in r["spans"].split(",") if s.startswith("random") and t[int(s.split(":")[1]):int(s.split(":")[2])].isdigit()]


def test_near_duplicates(spark, texts):
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    comp = {d: d for d in texts}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    for d, r in rows(spark, "op9_near_duplicates").items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[d]), root(d), root(d) == d)


def test_super_minhash_estimates_likeness():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    off = []
    for same in (10, 60, 300):
        for _ in range(20):
            rng.shuffle(pool)
            a, b = pool[:same + same // 4], np.concatenate([pool[:same], pool[2000:2000 + same // 4]])
            sig = neardup.super_minhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 160)
            off.append((sig[0] == sig[1]).mean() - same / (same + 2 * (same // 4)))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.045


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 50)] + [(205, 201), (206, 205), (206, 203)]
    comp = dict(neardup.components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(8)).collect())
    assert comp == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 50)} | {203: 201, 205: 201, 206: 201}


def test_links_inside_a_bucket_are_not_lost(spark):
    """A chain of texts of which only neighbours are alike, and a template that many unlike texts share."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 5:i * 5 + 100])) for i in range(12)]
    docs += [(100 + i, " ".join(words[:60]) + " " + " ".join(f"own{i}x{j}" for j in range(30))) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), k=4).collect()}
    assert all(got[i] == 0 for i in range(12)) and all(got[100 + i] == 100 + i for i in range(40))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in queries.QUERIES["op10_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic = sum(y for _, y in got)
    assert len(got) > 50 and sum(p and y for p, y in got) >= 0.8 * toxic and sum(p and not y for p, y in got) <= 0.05 * len(got)


def test_random_spans_recomputed(spark, texts):
    """Scores and cut-offs of every long token by plain Python, on the documents and on planted tokens."""
    import string
    rng = random.Random(9)
    letters = [string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_lowercase, string.digits]
    planted = {10_000 + i: f"the {''.join(rng.choice(letters[i % 4]) for _ in range(rng.randint(16, 70)))} and some_ordinary_identifier_{i}" for i in range(80)}
    everything = {**texts, **planted}
    model = secret_scan.train(spark.read.parquet(f"{SF}/documents.parquet"))
    square, cuts = secret_scan.SQUARE, model[2 * secret_scan.SQUARE:]

    def is_random(token):
        seen = list(dict.fromkeys(ord(a) * 128 + ord(b) for a, b in zip(token, token[1:])))
        own = sum(size for kind, size in secret_scan.CLASSES if re.search(kind, token))
        even = np.log(secret_scan.HEX_SIZE if re.search(secret_scan.HEX_ONLY, token) else own)
        score = max(sum(model[p] for p in seen), sum(model[square + p] for p in seen) - even * len(seen))
        cut = cuts[min(len(seen), secret_scan.LONGEST)] * max(1.0, len(seen) / secret_scan.LONGEST)
        return bool(re.search("[0-9A-Za-z]", token)) and not token.isdigit() and score >= cut

    docs = spark.createDataFrame(list(everything.items()), "doc_id bigint, text string")
    marked = 0
    for r in secret_scan.scan(docs, model).collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = [(int(a), int(b)) for k, a, b in spans if k != "random"]
        tokens = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=.-]{16,}", everything[r["doc_id"]])]
        want = [(a, b) for a, b, t in tokens if is_random(t) and not any(x < b and a < y for x, y in base)]
        assert [(int(a), int(b)) for k, a, b in spans if k == "random"] == want
        marked += len(want)
    assert marked >= 15


def test_toxic_scores_recomputed(spark, texts):
    """Every score from the model's bucket values, gram by gram."""
    from scholia.llm import toxicity
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    prime, golden, whole = 1099511628211, 0x9E3779B97F4A7C15, 2**64 - 1

    def bucket(gram):
        h = len(gram)
        for byte in gram:
            h = (h * prime + byte + 1) & whole
        return ((h ^ (h >> 29)) * golden & whole) >> 48

    def logit(word):
        marked = b"<" + word + b">"
        grams = [marked[i:i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        return sum(model.gains[bucket(g)] for g in grams) / len(grams)

    known = {}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for d, t in texts.items():
        zs = np.array([known.setdefault(w, known.get(w) if w in known else logit(w)) for w in sorted(toxicity.words(t))])
        z = 0.0
        if len(zs):
            a = np.exp((zs - zs.max()) / toxicity.COLDEST)
            z = float(a @ zs / a.sum())
        assert got[d] == pytest.approx(1 / (1 + np.exp(-np.clip(z + model.bias, -500, 500))), abs=1e-6)
    assert len({round(s, 3) for s in got.values()}) > 10
