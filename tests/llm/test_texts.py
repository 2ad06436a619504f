"""Token counts, SimHash, quality rules, packing and string dedup against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.compare import database, differ
from weftline.llm import packing, quality_rules, registry, simhash, suffix_dedup, token_counts


@pytest.fixture(scope="module")
def word_path():
    return token_counts.vocabulary_path(token_counts.VOCABULARY)


def test_queries_with_sql(spark, sf_dir):
    con = database(sf_dir)
    for name, sql in registry.ORACLE_SQL.items():
        assert differ(registry.QUERIES[name](spark, sf_dir), con, sql) is None, name


# operator 1


def test_totals_are_the_librarys(spark, docs, texts, word_path, sf_dir):
    lib = token_counts.PrefixCounter(word_path).lib
    rows = token_counts.token_counts(docs, word_path).collect()
    assert len(rows) == len(texts)
    want = {(d, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in texts}
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in rows} == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows) and any(r.over_limit for r in rows)
    c = token_counts.PrefixCounter(word_path)
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert c.total(r.text) == len(lib.encode(r.text, add_special_tokens=False).ids)


def test_every_prefix_is_the_librarys(word_path):
    c = token_counts.PrefixCounter(word_path)
    for t in ["", "don't they're I'll 'r 're 's", "Überall naïve élan!! ...x1y22", "<|endoftext|> a<|startoftext|>b <|end", "a" * 90, "tab\tnew\n\nline  --=="]:
        counts = c.prefixes(t)
        assert counts.tolist() == [len(c.lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)], t


def test_budget_cut(docs, word_path):
    c = token_counts.PrefixCounter(word_path)
    for r in token_counts.token_counts(docs, word_path, limit=7, prefixes=True).collect():
        counts = np.array(r.prefix_tokens)
        assert counts[-1] == r.n_tokens and counts[r.budget_cut] <= 7 and (counts[r.budget_cut + 1 :] > 7).all()
    assert c.prefixes("a b c")[-1] == 3


def test_budget_cut_without_all_prefixes(spark, sf_dir, word_path):
    """From the counts before each piece and those of one piece, the same as from the counts of all prefixes."""
    c = token_counts.PrefixCounter(word_path)
    rows = [r.text[:3000] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect() if r.text]
    for t in [*rows, "", "don't they're I'll 'r 're 's", "Überall naïve", "a" * 90, "tab\tnew\n\nline  --== ", "漢字 x\x1cy İ <|endoftext|> ok"]:
        counts = c.prefixes(t)
        for limit in (0, 1, 2, 7, 50, 300, 2048):
            assert c.budget_cut(t, c.total(t), limit) == np.flatnonzero(counts <= limit)[-1], (t, limit)


def test_a_vocabulary_without_a_byte(word_path):
    c = token_counts.PrefixCounter(word_path)
    c.vocab = frozenset(x for x in c.vocab if "z" not in x)
    with pytest.raises(ValueError, match="the vocabulary has no"):
        c.total("abz yz")


# operator 2


def slow_fingerprint(text: str | None, k: int = 3) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return "%016x" % sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def components(ids: list, linked) -> dict:
    part = {i: i for i in range(len(ids))}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                part[max(a, b)] = min(a, b)
    groups: dict = {}
    for i, d in enumerate(ids):
        groups.setdefault(root(i), []).append(d)
    return {d: min((x for x in g if x is not None), default=None) for g in groups.values() for d in g if d is not None}


def test_fingerprints_and_components(docs, texts):
    rows = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter((d, slow_fingerprint(t)) for d, t in texts)
    fp = [int(slow_fingerprint(t), 16) for _, t in texts]
    want = components([d for d, _ in texts], lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want


@pytest.mark.parametrize("tile", [2048, 4])
def test_links_between_many_close_fingerprints(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40)
    near = base[rng.integers(0, 40, 300)] ^ (1 << rng.integers(0, 62, 300)) ^ (1 << rng.integers(0, 62, 300))
    fps = np.unique(np.concatenate([base, near]))
    from weftline.llm.common import components as joined

    roots = {r.node: r.root for r in joined(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"))).collect()}
    want = components([int(x) for x in fps], lambda i, j: int(fps[i] ^ fps[j]).bit_count() <= 2)
    assert {int(x): roots.get(int(x), int(x)) for x in fps} == want


@pytest.mark.parametrize("tile", [2048, 6])
def test_near_copies_at_a_similarity(spark, tile):
    import random

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    rows, group = [], {}
    for g in range(25):
        words = [word() for _ in range(200)]
        for c in range(rnd.choice([1, 1, 3, 12])):
            copy = list(words)
            if c:
                copy[rnd.randrange(200)] = word()
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    rows.append((len(rows), None))
    got = {r.doc_id: r.component_id for r in simhash.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
    first: dict = {}
    for d, g in group.items():
        first.setdefault(g, d)
    assert got == {d: first[g] for d, g in group.items()} | {len(rows) - 1: len(rows) - 1}


def jaccard(a: str, b: str) -> float:
    a, b = a.split(), b.split()
    x, y = ({" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def revised(rnd, words: list[str], edits: int) -> list[str]:
    copy = list(words)
    for i in rnd.sample(range(10, 190), edits):
        copy[i] = "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    return copy


@pytest.mark.parametrize("tile", [2048, 6])
def test_components_are_those_of_the_shingles(spark, tile):
    """Texts of 0.55 to 0.79 are no near copies, however close their sketches; chains of revisions are one component."""
    import random

    rnd = random.Random(5)
    rows: list[str] = []
    for _ in range(6):
        base = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(200)]
        rows += [" ".join(revised(rnd, base, rnd.choice([2, 4, 5, 6, 7]))) for _ in range(12)]
        for _ in range(6):
            base = revised(rnd, base, 3)
            rows.append(" ".join(base))
    ids = list(range(len(rows)))
    want = components(ids, lambda i, j: jaccard(rows[i], rows[j]) >= 0.8)
    df = spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_components(df, tile=tile).collect()} == want


@pytest.mark.parametrize("tile", [2048, 8])
def test_every_pair_of_a_large_key_is_compared(spark, tile):
    """Two groups of one key that only two members link, whatever their places in the groups."""
    near, far = np.arange(40) % 4, 16 + np.arange(40) % 4
    rows = [(7, n, (1 << int(b) + 8) - 1 if n % 40 != 29 else (1 << 17) - 1 - (n >= 40), 0, 0, 0) for n, b in enumerate([*near, *(far + 4)])]
    sketch = [int(r[2]) for r in rows]
    df = spark.createDataFrame(rows, "key long, node long, f0 long, f1 long, f2 long, f3 long")
    from weftline.llm.common import components as joined

    roots = {r.node: r.root for r in joined(simhash.key_links(df, 0.8, tile, radius=6)).collect()}
    want = components(list(range(80)), lambda i, j: (sketch[i] ^ sketch[j]).bit_count() <= 6)
    assert {n: roots.get(n, n) for n in range(80)} == want


def test_one_of_each_keeps_rows_and_columns(docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 0 in ids and 105 not in ids and 107 not in ids


# operator 7


def test_packing_is_whole_and_exact(docs, texts):
    path = packing.vocabulary_path(packing.VOCABULARY)
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=64).toPandas()
    whole = Counter()
    for d, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        n = len(ids) % 64 or 64
        cuts = [0, *range(min(n, len(ids)), len(ids) + 1, 64)]
        whole.update((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    none = lambda x: None if x != x else int(x)
    assert Counter((none(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()) == whole
    rows = rows.sort_values(["sequence_id", "offset"])
    by = rows.groupby("sequence_id").length
    assert (rows.offset == by.cumsum() - rows.length).all() and by.sum().max() <= 64
    assert by.ngroups <= np.ceil(rows.length.sum() / 64) * 1.05 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_exactly_the_histogram(seed):
    rng = np.random.default_rng(seed)
    hist = rng.integers(0, 40, 257) * (rng.random(257) < [0.05, 0.5, 1, 0.2][seed])
    hist[0] = 0
    made = packing.plan(hist, 256)
    got = np.zeros(257, np.int64)
    for lengths, n in made:
        assert sum(lengths) <= 256 and n > 0
        for v in lengths:
            got[v] += n
    assert (got == hist).all()


def test_plans_are_close_to_the_bound(spark, sf_dir):
    """Sequences for the lengths of documents, as they are and with more of each: within 0.02 % of the tokens' bound."""
    enc = packing.Encoder(packing.vocabulary_path(packing.VOCABULARY))
    hist = np.zeros(1025, np.int64)
    for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet").select("text").collect():
        n = len(enc.ids(r.text or "")) // 4 + 1
        hist[1024] += n // 1024
        hist[n % 1024] += n % 1024 > 0
    for times in (1, 10, 100):
        tokens = int((hist * times * np.arange(1025)).sum())
        assert sum(n for _, n in packing.plan(hist * times)) <= -(-tokens // 1024) * 1.0002 + 1


@pytest.mark.parametrize("limit", [0, 1000])
def test_ranks_by_either_join(docs, limit):
    rows = packing.pieces(docs, packing.vocabulary_path(packing.VOCABULARY), 64)
    from weftline.llm.common import stage

    out = packing.packed(stage(rows, "pieces"), 64, limit).toPandas()
    assert not out.duplicated(["sequence_id", "offset"]).any() and out.groupby("sequence_id").length.sum().max() <= 64


# operator 6


def test_bucket_pointers_stand_for_bytes():
    rng = np.random.default_rng(6)
    for n in (199, 200, 207, 1500):
        d = np.tile(rng.integers(97, 99, 90).astype(np.uint8), -(-n // 90))[:n].copy()
        d[n // 2] = 1
        p, raw = suffix_dedup.bucket_pointers(d), d.tobytes()
        strings = [raw[i : i + 200] for i in range(len(raw) - 199)]
        assert len(p) == len(strings) and len({*zip(strings, p.tolist(), strict=True)}) == len(set(strings)) == len(set(p.tolist()))


def slow_removal(texts: list[bytes]) -> list[tuple]:
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                cover[i : i + 200] = True
        runs = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out.append((len(t), int(cover.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cover])).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 2}, {"broadcast_limit": 0}])
def test_removed_strings(docs, texts, limits):
    rows = suffix_dedup.removed(docs, **limits).collect()
    want = slow_removal([(t or "").encode() for _, t in texts])
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == Counter((d, *w) for (d, _), w in zip(texts, want, strict=True))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in rows)


@pytest.mark.parametrize("limits", [{}, {"hot": 2}])
def test_removal_across_blocks(spark, monkeypatch, limits):
    """Repeated strings that lie over the ends of a long text's blocks."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 300)
    rng = np.random.default_rng(7)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    shared = [word(450), word(230)]
    rows = [word(250) + shared[0] + word(77), word(31) + shared[0] + word(500) + shared[1], shared[1] + word(10), word(2500), shared[0][100:] + word(3)]
    rows += [rows[3][600:1700]]
    got = suffix_dedup.removed(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), **limits).collect()
    want = slow_removal([t.encode() for t in rows])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))


def test_removed_strings_of_long_texts(monkeypatch):
    """Blocks of a long text: every window is looked at in one of them."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 300)
    rng = np.random.default_rng(5)
    t = bytes(rng.integers(97, 123, 2000).astype(np.uint8))
    seen = []
    for data, ends, row, begins in suffix_dedup.groups([t, b"short"]):
        s = suffix_dedup.sampled(data, ends)
        part = np.searchsorted(ends, s["first"], side="right")
        shift = begins[part] - np.r_[0, ends[:-1]][part]
        for f, l, d in zip(s["first"], s["last"], shift, strict=True):
            seen += range(f + d, l + d + 1)
        assert set(row[part]) == {0}
    assert sorted(seen) == list(range(2000 - 199))


# operator 10


def test_ledger_edges_policies_and_ablation(docs, texts):
    rows = quality_rules.ledger(docs)
    got = rows.collect()
    assert len(got) == len(texts)
    empty = [r for r in got if not (r.text or "").split()]
    assert len(empty) == 4 and all(r.n_words == 0 and r.fail_bits & 1 for r in empty)
    periodic = next(r for r in got if r.doc_id == 109)
    assert (periodic.n_words, periodic.n_repeat_words) == (400, 400)
    for r in quality_rules.ablation(rows).collect():
        mask = quality_rules.mask(r.policy)
        own = [x.fail_bits & mask for x in got]
        bit = quality_rules.BITS[r.rule]
        assert (r.failed, r.alone, r.rejected) == (sum(o & bit != 0 for o in own), sum(o == bit for o in own), sum(o != 0 for o in own))
    assert rows.where(quality_rules.keeps("v2")).count() == sum(not x.fail_bits & quality_rules.mask("v2") for x in got)


def test_empty_tables(nothing, word_path):
    path = packing.vocabulary_path(packing.VOCABULARY)
    for df in (token_counts.token_counts(nothing, word_path), simhash.near_duplicates(nothing), simhash.one_of_each(nothing), packing.pack(nothing, path), suffix_dedup.removed(nothing), quality_rules.ledger(nothing)):
        assert df.count() == 0
    assert {r.failed for r in quality_rules.ablation(quality_rules.ledger(nothing)).collect()} == {0}
