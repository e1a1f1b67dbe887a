"""Phrase mining against a plain count: bursts, spills, exact scores, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagesift.llm import phrases
from pagesift.llm.phrases import HatTrie, count_phrases, merge_runs, mine_phrases, tokens_of

SCHEMA = "doc_id bigint, text string, lang string, phrase string, f int, rank int, a int, l int, r int, n int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_counts(docs):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    f["und" if lang is None else lang][" ".join(words[k : k + size])] += 1
    return f, n


def plainly(docs, least=10, share=50, top=2000):
    f, n = plain_counts(docs)
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if " " in p and a >= least}
        kept = []
        for p, a in cands.items():
            words = p.split(" ")
            cuts = []
            for k in range(1, len(words)):
                l, r = counts[" ".join(words[:k])], counts[" ".join(words[k:])]
                cuts.append((1_000_000 * a * a // (l * r), k, l, r))
            longer = [b for q, b in cands.items() if len(q.split(" ")) > len(words) and f" {p} " in f" {q} "]
            if not any(100 * b >= share * a for b in longer):
                score, _, l, r = min(cuts)
                kept.append((-score, -a, p.encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def made(spark, docs, **options):
    rows = [(k, text, lang, "x", 1, 2, 3, 4, 5, 6) for k, (text, lang) in enumerate(docs)]
    out = mine_phrases(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n, words=12, size=60):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "é", "Éa", "x y", "w\x00", "<b>", "\U0001f600"] + [f"w{k}" for k in range(words)]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "!", " "]
    return [
        ("".join(w + rng.choice(gaps) for w in rng.choices(vocabulary, k=rng.randrange(size))), rng.choice(["en", "de", None, "und", ""]))
        for _ in range(n)
    ]


def test_phrases_equal_the_plain_count(spark):
    docs = corpus(1, 400) + [(None, "en"), ("", "en"), (None, None), ("...", "fr"), ("one", "it")]
    docs += docs[:20]
    got = made(spark, docs, least=5)
    assert got == plainly(docs, least=5) and len(got) > 100


@pytest.mark.parametrize(("top", "share"), [(3, 50), (2000, 101), (2000, 0)])
def test_options(spark, top, share):
    docs = corpus(2, 150, words=4)
    assert made(spark, docs, least=4, top=top, share=share) == plainly(docs, 4, share, top)


def test_spills_and_bursts_change_nothing(spark, monkeypatch):
    docs = corpus(3, 300, words=40)
    whole = plainly(docs, least=3)
    assert made(spark, docs, least=3, entries=50) == whole
    tokens = [t for text, _ in docs for some in tokens_of(text.encode()) for t in some]
    small, large = HatTrie(burst=4), HatTrie()
    for start in range(0, len(tokens), 100):
        for trie in (small, large):
            old = min(start, 2)
            trie.count(tokens[start - old : start + 100], old)
    assert len(small.containers) > 50 and len(large.containers) == 1
    assert small.bounds == sorted(set(small.bounds)) and small.n_words == large.n_words
    # Only containers of one pair may be larger.
    for container in small.containers:
        assert len(container) <= 4 or len({key >> 21 for key in container}) == 1
    for k, (low, container) in enumerate(zip(small.bounds, small.containers, strict=True)):
        above = small.bounds[k + 1] if k + 1 < len(small.bounds) else 1 << 63
        assert all(low <= key < above for key in container)

    def held(trie, share):
        out = Counter()
        while trie.entries:
            keys, counts = trie.take(int(np.ceil(share * trie.entries)))
            out.update(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
        return out

    whole = held(large, 1)
    assert held(small, 0.5) == whole and sum(whole.values()) > len(tokens)
    small.count([b"a", b"b"])
    assert small.entries == 3


def test_a_long_text_is_cut_between_words(monkeypatch):
    monkeypatch.setattr(phrases, "_PIECE", 50)
    text = corpus(4, 1, size=3000)[0][0] + "x" * 200 + " y"
    expected = [t for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)) for t in [*re.findall(r"[^\x20\x09]+", p), "\xff"]]
    got = [t for some in tokens_of(text.encode()) for t in some]
    assert [t for t in got if t != b"\xff"] == [t.encode() for t in expected if t != "\xff"]
    assert got.count(b"\xff") == expected.count("\xff")


def test_runs_merge_by_phrase():
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    # A control character sorts before the tab that ends a phrase.
    runs = [pack(b"a\t3\na b\t1"), pack(b"a\x01\t2\na\t4"), pack(b"\t7"), pack(b"a\x01\t2\n\t1")]
    found = dict(zip(*merge_runs(runs, 4), strict=True))
    assert found == {b"": 8, b"a": 7, b"a\x01": 4}


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    counts = [("en", "a", 3_000_000_019), ("en", "b", 4_000_000_007), ("en", "a b", 2_999_999_929), ("en", "", 10**11)]
    table = spark.createDataFrame(counts, "lang string, phrase string, f bigint")
    monkeypatch.setattr(phrases, "count_phrases", lambda *_: table)
    row = mine_phrases(table).first()
    assert row.score == 1_000_000 * 2_999_999_929**2 // (3_000_000_019 * 4_000_000_007)
    assert (row.a, row.l, row.r, row.n) == (2_999_999_929, 3_000_000_019, 4_000_000_007, 10**11)


def test_a_hot_pair_is_spread(spark):
    docs = [(f"hot pair w{k} hot pair v{k}", "en") for k in range(3000)]
    df = spark.createDataFrame(docs, "text string, lang string")
    counted = {r.phrase: r.f for r in count_phrases(df, least=1).collect()}
    assert counted["hot pair"] == 6000 and counted["hot pair w7"] == 1 and counted[""] == 18_000
    runs = list(phrases._counted(iter([b for b in df.toArrow().to_batches()]), 64, 10_000))
    sizes = Counter()
    for batch in runs:
        for part, run in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            sizes[part] += len(merge_runs([run], 1)[0])
    assert max(sizes.values()) < 0.2 * sum(sizes.values())


def test_empty_table(spark):
    assert made(spark, []) == [] and made(spark, [("a b", "en")]) == []
