"""Token counts, alignment and ball k-means against the libraries, byte intervals and Lloyd's rounds in plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clausework.llm import alignment, ball_kmeans, token_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\r\nb;\r\n}\r\n", "x\t\ty", "tab\tbed \n line\n\n\nend", "\x00nul\x00", " nb sp 　 wide", "▁mark", "a ▁ b", "<s> </s> <unk> <0x41>",
    "<|endoftext|> and <|endoftext|>", "don't we'll I'M", "é ﬁ Ａ", "\U0001f600\U0001f468‍\U0001f469 ok", "日本語 の text", "a" * 900, "=" * 300 + " " * 40 + "\n" * 30, "\x1f\x1c sep \x85 nel", "12345 67,890.12", "the the the The THE",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = list(ODD)
    alphabet = "abe th\n\t\r .,;'<>|▁é́　\U0001f600\x00s1"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    out += [" ".join(rng.choice(["the", "contract", "Lizenz", "été", "x9k2", "quality,", "end.\n"]) for _ in range(rng.randrange(5, 2000))) for _ in range(30)]
    return out + [out[-1], out[-1]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 3 else None, t, "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, pair long").repartition(5)


@pytest.mark.parametrize("path", [B, A, public_tokenizers.path("word_bpe_49k.json")])
@pytest.mark.parametrize("chunk", [7, token_counts.CHUNK])
def test_token_counts(docs, texts, path, chunk):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(model.encode(t or "")) for t in texts]
    else:
        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        want = [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path, limit=1000, chunk=chunk).collect()}
    assert got == {(i if i != 3 else None, len((t or "").encode()), n, n > 1000) for i, (t, n) in enumerate(zip(texts, want, strict=True))}
    assert token_counts.count_tokens(docs.where("doc_id < 0"), path).count() == 0


def test_parts_are_safe_and_bounded(texts):
    for path in (A, B):
        model = token_counts.tokenizer(path)
        assert model.plain
        for t in filter(None, texts):
            assert "".join(token_counts.parts(model, t, 5)) == t
    prose = "a word and another " * 5000
    assert max(map(len, token_counts.parts(token_counts.tokenizer(B), prose, 1000))) < 1020
    assert not token_counts.tokenizer(public_tokenizers.path("word_bpe_49k.json")).plain


def aligned(texts):
    """Every text's ids, groups and links from byte intervals."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    letters, vocab = alignment.packing._byte_letters(), {i: w for w, i in a_model.get_vocab().items()}
    out = []
    for t in texts:
        if not t:
            out.append(([], [], [], []))
            continue
        a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
        a_bytes = [bytes(letters[c] for c in vocab[i]) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + t).encode()
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            out.append(([], [], [], []))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        ends = sorted(set(a_end.tolist()) & set(b_end.tolist()))
        groups, low = [], 0
        for e in ends:
            groups.append(([i for i, z in zip(a, a_end, strict=True) if low < z <= e], [i for i, z in zip(b, b_end, strict=True) if low < z <= e]) if len(whole) < 3000 else None)
            low = e
        links, j = [], 0
        a_begin, b_begin = a_end - [len(x) for x in a_bytes], b_end - [len(x) for x in b_bytes]
        for i in range(len(a)):
            while b_end[j] <= a_begin[i]:
                j += 1
            k = j
            while k < len(b) and b_begin[k] < a_end[i]:
                links.append((a[i], b[k]))
                k += 1
        out.append((a, b, ends if len(whole) >= 3000 else groups, links))
    return out


@pytest.mark.parametrize("hot", [alignment.HOT, 20, 0])
def test_alignment(docs, texts, hot):
    want = aligned(texts)
    counts = Counter(x for w in want for x in w[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = alignment.align(docs, hot=hot).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id if r.doc_id is not None else 3: r for r in rows}
    for i, (a, b, groups, links) in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links)), (i, texts[i])
        assert r.count_sum == sum(counts[x] for x in links)
        assert r.n_best == sum(counts[x] == most[x[1]] for x in links)
        if not a:
            assert r.groups_sha256 == ""
        elif isinstance(groups[0], tuple):
            shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            assert r.groups_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert alignment.align(docs.where("doc_id < 0")).count() == 0


def test_few_kept_segments(texts):
    """A memory that is cleared again and again, or not at all, gives the same groups."""
    known = alignment.Segments(A, B)
    shown = lambda g: None if g is None else b";".join(known.transducer.texts[x] for x in g)
    whole = [shown(g) for g in known.groups(texts)]
    for t, w in zip(texts, whole, strict=True):
        known.kept.clear()
        known.transducer.clear()
        assert shown(known.groups([t])[0]) == w


def test_transducer():
    words = [b"", b"ab", b"c", b"abc", b"abcd", b"d", b"x", b"e"]
    t = alignment.Transducer(words, words)

    def walked(a, b):
        found = t.walk(a, b)
        return None if found is None else ([t.texts[g].decode() for g in found], [(x & 0xFFFF, x >> 32) for g in found for x in t.links[g]])

    for _ in range(2):
        assert walked([1, 2, 5], [4]) == (["1,2,5|4"], [(1, 4), (2, 4), (5, 4)])
        assert walked([3, 5], [1, 2, 5]) == (["3|1,2", "5|5"], [(3, 1), (3, 2), (5, 5)])
        assert walked([1], [6]) is None and walked([1], [1, 2]) is None and walked([1, 2], [1]) is None and walked([4], [3]) is None and walked([], []) == ([], [])
    n = 3 * alignment.DEEP  # abc|ab, then c of one side beside the other's next word, without end
    long = alignment.Transducer([b"aa", b"a"], [b"aa", b"a"])
    assert [long.texts[g] for g in long.walk([1] + [0] * n + [1], [0] * (n + 1))] == [b"1," + b"0," * n + b"1|" + b",".join([b"0"] * (n + 1))]
    assert long.walk([1] + [0] * n, [0] * (n + 1)) is None


def lloyd(vectors, k, rounds):
    points = [[int(np.floor(1024 * float(x))) for x in v] for _, v in vectors]
    first = sorted(range(len(vectors)), key=lambda r: (vectors[r][0] is None, hashlib.sha256(f"3:{vectors[r][0]}".encode()).hexdigest(), vectors[r][1]))[:k]
    cent = [points[r] for r in first]
    near = lambda p: min((sum((x - y) ** 2 for x, y in zip(p, c, strict=True)), i) for i, c in enumerate(cent))
    for _ in range(rounds):
        own = [near(p)[1] for p in points]
        cent = [[sum(col) // len(col) for col in zip(*mine, strict=True)] if (mine := [p for p, o in zip(points, own, strict=True) if o == i]) else cent[i] for i in range(len(cent))]
    found = [near(p) for p in points]
    inertia = Counter()
    for d, i in found:
        inertia[i] += d
    return sorted((r[0] if r[0] is not None else -1, i, d, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, cent[i])).encode()).hexdigest()) for r, (d, i) in zip(vectors, found, strict=True))


def clusters(df, **kw):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in ball_kmeans.ball_kmeans(df, **kw).collect())


@pytest.mark.parametrize(("scale", "k", "dim", "rounds"), [(1.0, 8, 6, 10), (0.01, 5, 3, 4), (1e4, 6, 4, 5), (2e10, 4, 3, 3)])
def test_ball_kmeans(spark, scale, k, dim, rounds):
    rng = np.random.default_rng(int(scale))
    rows = [(i, [float(x) for x in rng.normal(size=dim) * scale + (i % 4) * scale * 3]) for i in range(400)]
    rows += [rows[5], rows[5], (7, rows[9][1]), (None, rows[2][1])]
    bad = [(900, None), (901, []), (902, [None] * dim), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [1.0] * (dim + 1))]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster string").repartition(3)
    want = lloyd(rows, k, rounds)
    if scale < 1e9:
        assert clusters(df, k=k, dim=dim, rounds=rounds) == want
    else:  # sums of distances pass the range of a long
        cut = 2**63 - 1
        got = clusters(df, k=k, dim=dim, rounds=rounds)
        assert [g[:2] + g[5:] for g in got] == [w[:2] + w[5:] for w in want]
        assert [g[2] for g in got] == [min(cut, w[2]) for w in want]


def test_ball_kmeans_ties_and_small_tables(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clusters(df, k=4, dim=2, rounds=6) == lloyd(rows, 4, 6)
    assert clusters(df.limit(1), k=4, dim=2, rounds=6) == lloyd(rows[:1], 4, 6)
    assert clusters(df.where("vec_id < 0"), k=4, dim=2) == []
    huge = spark.createDataFrame([(1, [1e308, -1e308]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.distance for r in ball_kmeans.ball_kmeans(huge, k=1, dim=2).collect()} == {1: 2**63 - 1, 2: 2**63 - 1}


def test_balls_compare_less():
    rng = np.random.default_rng(1)
    centres = [[int(x) for x in c] for c in rng.integers(-9000, 9000, (40, 8))]
    points = (np.array(centres)[rng.integers(0, 40, 3000)] + rng.integers(-300, 300, (3000, 8))).astype(np.int32)
    own, distance, _ = ball_kmeans.settle(points, np.zeros(3000, np.int32), ball_kmeans.Centroids(centres))
    every = ((points[:, None, :].astype(float) - np.array(centres)[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    again, _, taken = ball_kmeans.settle(points, own, ball_kmeans.Centroids([[x + 1 for x in c] for c in centres], centres))
    assert (again == own).all() and taken < 2 * 3000
    assert ball_kmeans.settle(points, own, ball_kmeans.Centroids(centres, centres))[2] == 3000


def test_registered(spark):
    from clausework.llm import registry

    assert {"op11_token_counts", "op12_token_alignment", "op13_ball_kmeans"} <= registry.queries().keys()
    assert "op13_ball_kmeans" in registry.oracle_sql()
