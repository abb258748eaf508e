import collections
import math
import random
import re

import numpy as np
import pytest
import tiktoken

from folioforge.llm import byte_bpe, exact_dedup, jaccard_join, license_scan, mixing, quality_model, quality_rules, sharding, suffix_dedup, toxicity
from folioforge.llm.components import components

from . import brute
from .conftest import documents


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, str(r[1:])))


# --- 1 ------------------------------------------------------------------------------------------------------------------


def stripped(docs):
    """Sorted results, rows with equal ones together."""
    return by_id((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.strip(docs).collect())


def stripped_by_force(rows):
    expected = brute.strip(rows)
    return by_id((r[0], *expected[r[0], r[1] or ""]) for r in rows)


def test_suffix_dedup_is_brute_force(docs, rows, empty):
    assert stripped(docs) == stripped_by_force(rows)
    got = suffix_dedup.strip(docs, texts=True).collect()
    assert sum(r.n_removed for r in got) > 5000 and all(len(r.kept) == r.n_bytes - r.n_removed for r in got)
    assert suffix_dedup.strip(empty).count() == 0


def shared_ids(rows):
    """Rows whose ids are shared by different texts, null ids too, and repeated rows that are the first of their kind."""
    long = [t for _, t, *_ in rows if t and len(t) > 250]
    more = [(1, long[0], "en", "s"), (1, "x", "en", "s"), (1, None, "en", "s"), (2, "lead " + long[0], "en", "s"), (3, long[0] + " tail", "en", "s"), (3, long[1], "en", "s"), (3, long[0], "en", "s")]
    more += [(None, long[k % 4] + f" end {k}", "en", "s") for k in range(8)] + [(None, None, None, None)] * 2
    return [(-5, "first of all " + long[2], "en", "s")] * 3 + more + [(-5, "first of all " + long[2], "en", "s")]


def test_suffix_dedup_of_rows_that_share_an_id(spark, rows):
    rows = shared_ids(rows)
    assert stripped(documents(spark, rows).repartition(3)) == stripped_by_force(rows)


def test_suffix_dedup_hot_grams(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    rows = rows + shared_ids(rows)
    assert stripped(documents(spark, rows).repartition(3)) == stripped_by_force(rows)


def test_suffix_dedup_goes_through_the_suffix_order(monkeypatch):
    none = np.zeros(0, dtype=np.int64)
    monkeypatch.setattr(suffix_dedup, "equal_windows", lambda data, at, group: (none, none))
    assert np.array_equal(suffix_dedup._duplicate_windows(np.array([1, 1]), np.array([16 << 16 | 16 << 8 | 16] * 2), [b"x" * 100] * 2)[0], none)
    monkeypatch.undo()
    assert len(suffix_dedup._duplicate_windows(np.array([1, 1]), np.array([16 << 16 | 16 << 8 | 16] * 2), [b"x" * 100] * 2)[0]) == 1


def test_suffix_dedup_above_a_mebibyte(spark):
    r = random.Random(2)
    passage = " ".join(f"p{r.random()}" for _ in range(30))
    body = [" ".join(str(r.random()) for _ in range(k)) for k in (60_000, 20)]
    rows = [(1, f"{body[0]} {passage} z", "en", "s"), (2, f"q {passage} {body[1]}", "en", "s"), (3, body[0][700_000:1_100_000], "en", "s"), (4, "é" * 700_000, "en", "s")]
    assert len(rows[0][1]) > 1 << 20
    assert stripped(documents(spark, rows)) == stripped_by_force(rows)


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer(("the cat sat on a mat " * 40 + "x" * 150).encode(), dtype=np.uint8)
    covered = lambda: {(int(p), int(a + at)) for at, b, n in suffix_dedup.blocks(data) for _, a, f, z in zip(*suffix_dedup.anchors(b, n), strict=True) for p in range(f + at, z + at + 1)}
    whole = covered()
    monkeypatch.setattr(suffix_dedup, "BLOCK", 130)
    assert covered() == whole and len(whole) == len(data) - suffix_dedup.LENGTH + 1


def test_equal_windows_by_sorting():
    text = b"abcdefgh" * 40 + b"x" + b"abcdefgh" * 40
    data = np.frombuffer(text + bytes(8), dtype=np.uint8)
    at = np.arange(len(text) - 99)
    index, kind = suffix_dedup.equal_windows(data, at, np.zeros(len(at), dtype=int))
    groups = collections.defaultdict(list)
    for p in at:
        groups[text[p : p + 100]].append(int(p))
    got = collections.defaultdict(list)
    for i, k in zip(index, kind, strict=True):
        got[k].append(int(i))
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


# --- 2 ------------------------------------------------------------------------------------------------------------------


def test_bpe_is_tiktoken(docs, rows, empty):
    import hashlib

    path, pattern = byte_bpe.installed()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.encode_documents(docs, ids=True).collect()}
    for doc_id, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        r = got[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.ids) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), ids)
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(empty).count() == 0


def test_bpe_long_pretokens():
    bpe = byte_bpe.load(*byte_bpe.installed())
    own = tiktoken.Encoding("own", pat_str=byte_bpe.installed()[1], mergeable_ranks=bpe.ranks, special_tokens={})
    for text in ("ab" * 5000, "a" * 4001, "äöü" * 700, "x" * 3 + "😀" * 50, "thethethe" * 300, "\x00\x01" * 100):
        assert bpe.encode(text) == own.encode_ordinary(text) and bpe.decode(bpe.encode(text)) == text.encode()
    assert not bpe.queue.root and not bpe.queue.buckets


def test_rank_queue_order():
    q = byte_bpe.RankQueue()
    items = [(5, 3), (5, 1), (70_000, 2), (64, 9), (5, 2), (0, 8)]
    for item in items:
        q.push(*item)
    got = []
    while q.root:
        got.append(q.pop())
    assert got == sorted(items)


# --- 3 ------------------------------------------------------------------------------------------------------------------


def test_join_is_brute_force(docs, rows, empty):
    got = by_id((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == by_id((r[0], *x) for r, x in zip(rows, brute.near(rows), strict=True))
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_join_in_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    got = by_id((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect())
    expected = by_id((r[0], *x) for r, x in zip(rows, brute.near(rows), strict=True))
    assert sum(g[2] for g in got) >= 0.97 * sum(e[2] for e in expected)


def test_join_keeps_one_of_each_class(docs, rows):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {c for c, _ in brute.near(rows)}
    assert {r.doc_id for r in kept.collect()} == classes


def test_recall_of_pairs_at_the_threshold():
    r = np.random.default_rng(1)
    hits, runs = 0, jaccard_join.runs_needed()
    for _ in range(150):
        common, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (160, 20, 20))
        paths = [{int(p) for lv, p in zip(*(x[k] for k in (0, 2)), strict=True) if lv == jaccard_join.DEPTH} for x in (jaccard_join.chosen_paths(np.concatenate([common, y]), runs) for y in (a, b))]
        hits += bool(paths[0] & paths[1])
    assert hits >= 145


def test_long_words_and_texts_are_hashed_alike(monkeypatch):
    data = np.frombuffer(b"aa bbb  cc\ndddd " * 20, dtype=np.uint8)
    whole = jaccard_join.shingles(data)
    monkeypatch.setattr(jaccard_join, "_PIECE", 11)
    assert (jaccard_join.shingles(data) == whole).all() and len(jaccard_join.word_hashes(np.frombuffer(b"x" * 50 + b" y", dtype=np.uint8))) == 2


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(3, 2), (7, 7), (2, 1)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 10 for k in range(10, 41)} | {1: 1, 2: 1, 3: 1}
    assert components(edges.limit(0)).count() == 0


# --- 4 and 8 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("model", [quality_model, toxicity])
def test_classifier_on_odd_rows(model, docs, rows, empty, labels):
    got = model.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert model.classify(empty, labels).count() == 0
    none = model.classify(docs, labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1


@pytest.mark.parametrize(("model", "label", "least"), [(quality_model, "quality", 0.95), (toxicity, "toxic", 0.9)])
def test_classifier_on_held_out_rows(spark, model, label, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = model.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    right = sum(r.predicted == r[label] for r in got)
    assert right / len(got) >= least
    clean = [r for r in got if r[label] == (0 if label == "toxic" else 1)]
    assert sum(r.predicted == r[label] for r in clean) / len(clean) >= 0.98


def test_quality_model_sees_the_order_of_words():
    r = random.Random(3)
    words = "river stone walls carry slow water past green fields toward open hills".split()

    def text(ordered):
        """Each word five times, no equal neighbours."""
        rounds = [words] * 5 if ordered else [r.sample(words, len(words)) for _ in range(5)]
        return text(ordered) if any(a[-1] == b[0] for a, b in zip(rounds, rounds[1:], strict=False)) else " ".join(w for x in rounds for w in x)

    rows = [(text(k % 2 == 1), k % 2) for k in range(120)]
    weights, extract = quality_model.fit(rows[:80]), quality_model.Extractor()
    assert all((quality_model.apply(t, weights, extract) >= 0.5) == (y == 1) for t, y in rows[80:])


def test_counterfactual_penalty_spares_group_names():
    rows = [("you women are idiot trash", 1), ("women met today", 0), ("women are idiot fools", 1), ("men met today", 0), ("men talk here", 0), ("what trash", 1)] * 30 + [("fine text about rivers", 0)] * 30
    plain, held = toxicity.fit(rows, penalty=0.0), toxicity.fit(rows, penalty=2.0)
    gap = lambda w: abs(sum(w.get(c, 0) for c in toxicity.codes("women")) - sum(w.get(c, 0) for c in toxicity.codes("men")))
    assert gap(held) < gap(plain) and held[toxicity.codes("idiot")[0]] > 0
    assert toxicity.counterfactual({"women", "x"}) == {"men", "x"} and toxicity.counterfactual({"x"}) is None


def test_toxic_documents_go(docs, labels):
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    scores = collections.Counter((r.doc_id, r.score < 0.3) for r in toxicity.classify(docs, labels).collect())
    assert kept.count() == sum(n for (_, clean), n in scores.items() if clean)


# --- 5 ------------------------------------------------------------------------------------------------------------------


def test_exact_dedup_is_brute_force(docs, rows, empty):
    got = by_id((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.duplicate_groups(docs, digests=True).collect())
    assert got == by_id((r[0], *x) for r, x in zip(rows, brute.copies(rows), strict=True))
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def test_only_groups_that_survive_are_hashed_in_full(docs):
    got = exact_dedup.duplicate_groups(docs).collect()
    assert all(r.full_hash for r in got if r.group_size > 1) and any(r.full_hash is None for r in got)


def test_exact_dedup_keeps_whole_rows(docs, rows):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(dict.fromkeys({k for k, *_ in brute.copies(rows)}, 1))


# --- 6 ------------------------------------------------------------------------------------------------------------------


def licenses_by_force(rows, templates):
    """Sorted (doc_id, licenses) of each row, by exact containment."""

    def shingles(text, n):
        w = license_scan.words_of(text or "")
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    def names(text):
        for name, template in templates.items():
            n = min(5, len(license_scan.words_of(template)))
            wanted = shingles(template, n)
            if len(shingles(text, n) & wanted) / len(wanted) >= 0.8:
                yield name

    return by_id((r[0], ",".join(sorted(names(r[1])))) for r in rows)


def scanned(docs, templates=None):
    got = license_scan.report(docs, templates).collect()
    assert all(r.n_licenses == len(list(filter(None, r.licenses.split(",")))) for r in got)
    return by_id((r.doc_id, r.licenses) for r in got)


def notices():
    mit = license_scan.TEMPLATES["mit-grant"]
    extra = [(900, "x y Licensed under the Apache License, Version 2.0."), (901, "released UNDER the mit license"), (902, "Released under the BSD License."), (903, f"q {mit} z"), (904, mit.replace("sublicense", "SUB")), (905, mit[: len(mit) // 2])]
    extra += [(906, " ".join(["w"] * k) + " Licensed under CC BY-NC 4.0.") for k in range(4)]
    extra += [(None, "Released under the MIT License."), (None, "nothing to see here at all"), (None, None), (7, "Released under the MIT License."), (7, "All rights reserved."), (7, "All rights reserved.")]
    return [(i, t, None, None) for i, t in extra]


def test_license_scan_is_brute_force(spark, rows, empty):
    every = rows + notices()
    assert scanned(documents(spark, every).repartition(3)) == licenses_by_force(every, license_scan.TEMPLATES)
    assert license_scan.report(empty).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(empty, {"x": "too short"})


def test_license_scan_goes_through_its_bands(spark, monkeypatch):
    docs = documents(spark, notices())
    index = license_scan.band_index
    monkeypatch.setattr(license_scan, "band_index", lambda *a: index(*a).where("license <> 'mit'"))
    got = {n for _, names in scanned(docs) for n in names.split(",")}
    assert "mit" not in got and {"mit-grant", "apache-2.0", "all-rights-reserved"} <= got


def test_license_scan_of_whole_licenses(spark, tmp_path):
    r = random.Random(6)
    words = [f"term{k}" for k in range(900)]
    texts = {f"license-{k}": " ".join(r.choice(words) for _ in range(n)) for k, n in enumerate((28, 60, 400, 6000))}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text)
    templates = license_scan.read_templates(str(tmp_path))
    assert templates == texts

    def edited(text, every):
        return " ".join(f"edit{k}" if k % every == every // 2 else w for k, w in enumerate(text.split()))

    rows = []
    for k, text in enumerate(texts.values()):
        cuts = [text, f"lead in {text} and more {' '.join(r.choices(words, k=50))}", edited(text, 40), edited(text, 26), edited(text, 12), text[: len(text) // 2], "pad " * 200_000 + text]
        rows += [(10 * k + j, t, None, None) for j, t in enumerate(cuts)]
    got = scanned(documents(spark, rows), templates)
    assert got == licenses_by_force(rows, templates) and sum(bool(n) for _, n in got) >= 16


def test_license_scan_finds_notices_of_fewer_than_five_words(spark):
    texts = ["All rights reserved.", "x y\nALL rights, reserved\nz", "all rights are reserved", "w All rights reserved " * 3, "Made under MIT terms", "rights reserved", "", None]
    templates = license_scan.TEMPLATES | {"four": "made under mit terms"}
    got = {r.doc_id: r.licenses for r in license_scan.report(documents(spark, [(k, t, None, None) for k, t in enumerate(texts)]), templates).collect()}
    assert got == {0: "all-rights-reserved", 1: "all-rights-reserved", 2: "", 3: "all-rights-reserved", 4: "four", 5: "", 6: "", 7: ""}


def test_license_scan_finds_both_wordings_of_cc_by(spark):
    texts = ["Licensed under CC BY 4.0.", "x licensed under CC BY 4.0 International. y", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 3.0."]
    got = {r.doc_id: r.licenses for r in license_scan.report(documents(spark, [(k, t, None, None) for k, t in enumerate(texts)])).collect()}
    assert got == {0: "cc-by-4.0", 1: "cc-by-4.0", 2: "cc-by-nc-4.0", 3: ""}


def test_planted_notices_are_all_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = {r.doc_id for r in docs.collect() if "All rights reserved." in (r.text or "")}
    found = {r.doc_id for r in license_scan.report(docs).collect() if "all-rights-reserved" in r.licenses}
    assert planted and planted <= found


# --- 7 ------------------------------------------------------------------------------------------------------------------


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(brute.WORD.findall(text or ""))
    target = brute.targets(sizes)
    source = {r[0]: r[3] for r in rows}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r.source_size, round(r.target, 6)) == (sizes[s], round(target[s], 6)) and r.size <= sizes[s] and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in sizes) and len(got) == len(rows)
    again = sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert again == sorted(map(str, got))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixed_rows_are_repeated(docs):
    times = collections.Counter({(r.doc_id, r.size): r.taken // r.size for r in mixing.mix(docs).collect() if r.size})
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = collections.Counter((r.doc_id, len(brute.WORD.findall(r.text))) for r in mixed.collect())
    assert {k: n for k, n in got.items() if k[0] != 300} == {k: n for k, n in times.items() if n and k[0] != 300}


def test_mixing_refines_bins_until_few_rows_are_left(docs, monkeypatch):
    whole = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BINS", 2)
    monkeypatch.setattr(mixing, "FEW", 1)
    assert sorted(map(str, mixing.mix(docs).collect())) == whole


def test_targets_of_many_sources(spark):
    r = random.Random(4)
    rows = [(f"s{k:03d}" if k else None, r.choice([0, 1, 5, 30, 1000, 20_000])) for k in range(200)]
    got = {x.source: x.target for x in mixing.source_targets(spark.createDataFrame(rows, "source string, size long").repartition(7)).collect()}
    expected = brute.targets(dict(rows))
    assert got.keys() == expected.keys() and all(got[s] == pytest.approx(t, rel=1e-12) for s, t in expected.items())


def test_better_documents_come_first(spark):
    rows = [(k, ("word " * 20) + ("# " * 20 if k % 2 else "item " * 20), "en", s) for k in range(600) for s in ["a"]] + [(10_000 + k, "x " * 4000, "en", "b") for k in range(1)]
    got = mixing.mix(documents(spark, rows)).where("doc_id < 10000").collect()
    share = lambda odd: sum(r.taken for r in got if r.doc_id % 2 == odd) / sum(r.size for r in got if r.doc_id % 2 == odd)
    assert share(0) > share(1)


# --- 9 ------------------------------------------------------------------------------------------------------------------


def test_lookup_table():
    names = sharding.shard_names(64)
    table = sharding.lookup_table(names)
    share = collections.Counter(table)
    assert len(share) == 64 and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.lookup_table(names[:-1])
    stayed = sum(a == b for a, b in zip(table, fewer, strict=True) if a != 63)
    assert stayed / len(table) > 0.85
    for bad in (([], 7), (names, 61), (names, 100)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding_rows(docs, rows, empty):
    import hashlib

    table = sharding.lookup_table(sharding.shard_names())
    expected = by_id((r[0], table[int(hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:15], 16) % len(table)]) for r in rows)
    assert by_id((r.doc_id, r.shard) for r in sharding.assign_shards(docs).collect()) == expected
    assert sharding.assign_shards(empty).count() == 0
    clashing = docs.select("doc_id", docs["lang"].alias("_slot"), docs["source"].alias("_shard"), docs["text"].alias("_doc"), docs["n"].alias("shard"))
    placed = sharding.assign_shards(clashing)
    assert placed.columns == clashing.columns and placed.dtypes[-1] == ("shard", "int")
    assert {(r.doc_id, r._slot, r._shard) for r in placed.collect()} == {(r[0], r[2], r[3]) for r in rows}


# --- 10 -----------------------------------------------------------------------------------------------------------------


def test_quality_rule_counts(docs, rows, empty, labels):
    got = by_id((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(docs, labels).collect())
    assert got == by_id((r[0], *brute.counts(r[1])) for r in rows)
    assert quality_rules.judge(empty, labels).count() == 0 and quality_rules.judge(docs, labels.limit(0)).count() == len(rows)


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(100, 0), (100, 1), (1000, 5), (50_000, 550), (100, 90), (0, 0)]
    frame = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.0125).alias("p"))
    for r in frame.collect():
        log = lambda i, n=r.n: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.0125) + (n - i) * math.log(0.9875)
        exact = sum(math.exp(log(i)) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-6) or (r.k > r.n * 0.0125 and r.p == 1.0)


def test_cutoffs_keep_good_documents(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60)) + " #" * (k % 3 == 0) * 12
    rows = [(k, text(k), "en" if k < 900 else "de", "s") for k in range(1000)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 3 != 0 or k % 50 == 0), 0) for k in range(1000)], "doc_id long, quality int, toxic int")
    cuts = {r.stratum: r for r in quality_rules.cutoffs(quality_rules.materialise(quality_rules.base_counts(docs, "doc_id", "lang"), "counts"), labels).collect()}
    assert cuts["en"].cut_dup_lines == 0.1 and cuts["de"].cut_dup_lines is None
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    good = [k for k in range(900) if k % 3 != 0 or k % 50 == 0]
    assert sum(not got[k].kept for k in good) / len(good) <= quality_rules.ALPHA


def test_queries_are_registered():
    import __spark_entry__ as entry
    import corpus_pipeline

    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if re.match(rf"op{n}_", q)]) == 1
    assert "pipeline" in names and [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]


def test_bpe_of_long_texts_in_parts(monkeypatch):
    text = "Some words here.\nAnd MORE words!! 12\n" * 60 + "tail without end " * 30
    bpe = byte_bpe.load(*byte_bpe.installed())
    short = bpe.encode(text)
    monkeypatch.setattr(byte_bpe, "LONG", 100)
    assert bpe.encode(text) == short


@pytest.mark.parametrize("text", ["word\t" * 300_000, "x" * 1_300_000, "one two Three4!\n" * 100_000, "a b\u2003c\x1cd " * 200_000], ids=["tabs", "one word", "lines", "odd blanks"])
def test_quality_features_of_texts_above_a_mebibyte(text):
    at, value = quality_model.Extractor()(text)
    plain = brute.quality_features(text, quality_model)
    assert set(at.tolist()) == set(plain) and all(plain[k] == pytest.approx(v, rel=1e-9) for k, v in zip(at.tolist(), value.tolist(), strict=True))


def labelled_texts(n=150):
    r = random.Random(8)
    common = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(n):
        bad = k % 3 == 0
        words = [r.choice(common) for _ in range(r.randint(3, 40))] + ["Idiots!!"] * (2 * bad) + [f"only{k}"] + (["women"] if k % 4 == 0 else ["muslim", "asian"] if k % 7 == 0 else [])
        r.shuffle(words)
        rows.append((" ".join(words).replace(" w1 ", "\n") if k % 5 else "", int(bad)))
    return rows


def test_quality_model_is_a_plain_one():
    rows = labelled_texts()
    weights, plain = quality_model.fit(rows), brute.quality_weights(rows, quality_model)
    assert all(weights[f if f != "bias" else -1] == pytest.approx(w, abs=1e-9) for f, w in plain.items()) and np.count_nonzero(weights) == sum(w != 0 for w in plain.values()) > 20
    extract = quality_model.Extractor()
    for text, _ in rows[:20]:
        z = plain["bias"] + sum(v * plain.get(f, 0.0) for f, v in brute.quality_features(text, quality_model).items())
        assert quality_model.apply(text, weights, extract) == pytest.approx(brute.logistic(z), abs=1e-9)


def test_toxicity_model_is_a_plain_one():
    rows = labelled_texts()
    weights, plain = toxicity.fit(rows), brute.toxic_weights(rows, toxicity)
    assert weights.keys() == plain.keys() and len(plain) > 5 and all(weights[f] == pytest.approx(w, abs=1e-9) for f, w in plain.items())


def test_leaving_out_features_of_one_text_changes_nothing():
    rows = labelled_texts(300) + [(f"rare{k} women gay old{k}", k % 2) for k in range(40)]
    pruned, full = toxicity.fit(rows), toxicity.fit(rows, prune=False)
    assert pruned.keys() == full.keys() and all(pruned[f] == pytest.approx(w, abs=1e-12) for f, w in full.items())


def test_training_takes_features_up_to_its_bound(docs, labels, monkeypatch):
    whole = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "MAX_TRAIN_BYTES", 2000)
    assert whole and toxicity.train(docs, labels) != whole
