import hashlib
import json
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from siftwell.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "the cat sat on the mat", "The cat  sat\n\n on\tthe mat. ", " leading and trailing ", "naïve café über ñandú ’quoted’ — dash", "日本語のテキスト and 한국어 🙂🙂", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "don't we'll I'M 12345 6,789.01 x=y+z; {a:[1,2]}", "\x00\x01 control", "a▁b", "   ", "\n", "x", "é" * 50, "tab\t\tand   spaces      many", "​zero﻿width 　 ideographic \x85 next",
]


def _by_hand(texts):
    """Each text from loops over the libraries' own ids, by the contract's words."""
    a_lib = Tokenizer.from_file(A)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B)
    vocab = {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}
    chars = align.byte_of_char()

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a = a_lib.encode(" " + text, add_special_tokens=False).ids
            b = b_lib.encode(text)
            ab, bb = [bytes(chars[c] for c in vocab[i]) for i in a], [b_bytes(i) for i in b]
            if not b"".join(ab) == b"".join(bb) == (" " + text).encode():
                a = b = []
        if not a:
            docs.append((0, 0, [], []))
            continue
        ends_a, ends_b = list(accumulate(map(len, ab))), list(accumulate(map(len, bb)))
        groups, links, own_a, own_b, k = [], [], [], [], 0
        for i, end in zip(a, ends_a):
            own_a.append(i)
            while k < len(b) and ends_b[k] <= end:
                own_b.append(b[k])
                k += 1
            if k and ends_b[k - 1] == end:
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                links.append((i, b[k - 1]))
                own_a, own_b = [], []
        counts.update(links)
        docs.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    rows = [(na, nb, len(g), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for na, nb, g, ls in docs]
    return rows, {(a, b, n, n == best[b]) for (a, b), n in counts.items()}, [";".join(g) for _, _, g, _ in docs]


def _rows(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_against_loops(spark):
    texts = TEXTS * 3 + TEXTS[:2] * 5 + [None, ""]
    docs = spark.createDataFrame([(i % 40 if i != 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(5)
    want, pairs, groups = _by_hand([t or "" for t in texts])
    want = sorted([(i % 40 if i != 7 else None, *w) for i, w in enumerate(want)], key=str)
    assert sum(w[1] > 0 for w in want) > 30 and any(w[1] == 0 for w in want)
    assert _rows(align.score(docs, A, B)) == want
    assert _rows(align.score(docs, A, B, stripe_bytes=1 << 21, chunk_chars=30)) == want
    assert {(r.a, r.b, r["count"], r.best) for r in align.pair_counts(docs, A, B).collect()} == pairs
    assert Counter(r.groups for r in align.groups(docs, A, B).collect()) == Counter(groups)


def test_given_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want, _, _ = _by_hand([t or "" for _, t in rows])
    got = queries.op11_token_alignment(spark, d)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert _rows(got) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=str)


def test_long_texts_are_cut_where_both_sides_cut(spark, monkeypatch):
    sides = align._sides(align._read(A), align._read(B))
    assert sides.b_cuts
    text = "some words and more of them, 12 3 naïve ünder 日本 end " * 60
    whole = sides.cut(text)
    monkeypatch.setattr(align, "PART_CHARS", 40)
    assert len(align._parts(text)) > 20 and sides.cut(text) == whole


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.score(docs, A, B).count() == 0 and align.groups(docs, A, B).count() == 0
    assert _rows(align.score(spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string"), A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_stripes_are_bounded():
    assert align.stripe_count(50257, 32000, 32 << 20) == 386 and align.stripe_count(10, 5, 1) == 5
