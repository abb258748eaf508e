"""Operators 11 to 13 against plain versions, on odd rows."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from folioforge.llm import conversation_repair, decontamination, source_divergence

from .conftest import documents

# --- 11 -----------------------------------------------------------------------------------------------------------------


def audited(rows, min_docs, top):
    """(lang, source, part, item, value, rank) by force: every term, every pair."""
    count, docs, sources = collections.defaultdict(collections.Counter), collections.Counter(), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        sources.add((lang, source))
        count[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
    kept = collections.defaultdict(list)
    for (lang, w), n in docs.items():
        if n >= min_docs:
            kept[lang].append(w)
    out = []
    for lang, source in sources:
        terms, all_of = kept[lang], sum((count[k] for k in sources if k[0] == lang), collections.Counter())
        total = lambda c: sum(c[t] for t in terms)  # noqa: E731,B023
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (total(c) + 5 * len(terms))  # noqa: E731,B023
        mine = count[lang, source]
        pairs = [(sum(abs(p(mine, t) - p(count[lang, o], t)) for t in terms), o) for g, o in sources if g == lang and o != source]
        more = [(p(mine, t) - p(all_of, t), t) for t in terms if mine[t] and p(mine, t) > p(all_of, t)]
        for part, found in (("pair", pairs), ("term", more)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def plain(df):
    return sorted(map(tuple, df.collect()))


def test_audit_is_brute_force(docs, rows, empty):
    for min_docs, top in ((3, 5), (1, 50), (1000, 50)):
        assert plain(source_divergence.audit(docs, min_docs, top)) == audited(rows, min_docs, top)
    assert source_divergence.audit(empty).count() == 0


def test_audit_of_ties_long_texts_and_repeated_rows(spark, monkeypatch):
    rows = [(k, "same words Here " * 3, "en", f"s{k % 3}") for k in range(9)] + [(9, None, "en", "none"), (10, "x-É9y_z", None, None), (10, "x-É9y_z", None, None)]
    rows += [(11, "long " * 600_000 + "q" * 2_000_000, "en", "s0"), (12, "ÄÖ äö ÄÖ", "de", ""), (13, "only", "de", None)]
    got = plain(source_divergence.audit(documents(spark, rows).repartition(4), 2))
    assert got == audited(rows, 2, 50)
    assert [r[3] for r in got if r[:3] == ("en", "none", "pair")] == ["s0", "s1", "s2"]


def test_vectors_stand_for_all_their_terms(spark):
    rows = [(k, "aa bb cc dd", "en", f"s{k % 2}") for k in range(8)] + [(9, "ee", "en", "s0"), (10, "ee", "en", "s0")]
    kept = source_divergence.term_vectors(documents(spark, rows), 2)
    assert kept.count() == 5 and kept.select("vector").distinct().count() == 2


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    n, total, v = 123_456_789_012_345, 987_654_321_098_765_432, 12_345_678
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(source_divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_pieces_cut_between_terms(monkeypatch):
    text = b"ab cd,efgh  " * 50 + b"x" * 90
    monkeypatch.setattr(source_divergence, "PIECE", 7)
    found = list(source_divergence.pieces(text))
    assert b"".join(found) == text and len(found) > 20
    assert [w for p in found for w in source_divergence._TERM.findall(p)] == source_divergence._TERM.findall(text)


# --- 12 -----------------------------------------------------------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def repaired(turns):
    """Everything but the id of one conversation, from the end on: the best edits from a turn and a state of the pattern."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    known, faults = set(), []
    for _, role, text in turns:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not words else "d" if (role, text) in known else "t" if words[-1] not in ".!?" else "k")
        known.add((role, text))
    follow = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, inserts):
        if i == len(turns) and state in "0a":
            end = [(0, "", ())]
        else:
            end = []
        if inserts < 2:
            for new, name in (("u", "user"), ("a", "assistant")):
                if (state, new) in follow:
                    c, a, r = best(i, follow[state, new], inserts + 1)
                    end.append((c + 3, "I" + a, (f"{name}:", *r)))
        if i < len(turns):
            _, role, text = turns[i]
            c, a, r = best(i + 1, state, 0)
            end.append((c + 4, "D" + a, r))
            if faults[i] in "tk":
                more = 3 * (faults[i] == "t")
                for edit, new, name, price in (("K", role[:1], role, 0), ("R", "u", "user", 3), ("R", "a", "assistant", 3)):
                    if (state, new) in follow:
                        c, a, r = best(i + 1, follow[state, new], 0)
                        end.append((c + price + more, edit + a, (f"{name}:{text}", *r)))
        return min(end) if end else (10**9, "", ())

    cost, audit, out = best(0, "0", 0)
    numbers = [t[0] for t in turns if t[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations(n, seed=3):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, 9)):
            text = r.choice(["Yes.", "No!", "What?", "cut", "", " \n", "Good.  ", None, f"t{turn}."])
            rows.append((conv if conv else None, r.choice([turn, turn, turn, turn + 2, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def by_force(rows, all_rows):
    groups = collections.defaultdict(list)
    for conv, *turn in rows:
        groups[conv].append(tuple(turn))
    return {conv: repaired(groups[conv]) for conv in {r[0] for r in all_rows}}


def as_dict(df):
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.mark.parametrize("chunk", [1000, 2])
def test_repair_is_brute_force(spark, chunk):
    rows = conversations(150)
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", n int, fault string").repartition(3)
    assert as_dict(conversation_repair.repair(given.select("conv_id", "turn", "role", "text"), chunk)) == by_force([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], rows)
    assert as_dict(conversation_repair.repair(conversation_repair.damage(given), chunk)) == by_force(damaged(rows), rows)


def test_repair_of_one_long_conversation(spark):
    r = random.Random(1)
    rows = [(7, k // 2, r.choice(["user", "assistant", "system"]), r.choice(["Same.", f"turn {k}.", f"turn {k}", ""])) for k in range(700)]
    rows += [(8, 0, "user", "é" * 3_000_000), (8, 1, "assistant", "Fine.")]
    given = spark.createDataFrame(rows, SCHEMA).repartition(5)
    import sys

    deep = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        expected = by_force(rows, rows)
    finally:
        sys.setrecursionlimit(deep)
    for chunk in (1000, 37):
        assert as_dict(conversation_repair.repair(given, chunk)) == expected
        turns = conversation_repair.repaired_turns(given, chunk).where("conv_id = 7").orderBy("part", "seq", "i").collect()
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == expected[7][-1]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair(conversation_repair.damage(none)).count() == 0
    turn = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)  # dropped
    row = conversation_repair.repair(conversation_repair.damage(spark.createDataFrame([(1, turn, "user", "Hi.")], SCHEMA))).collect()
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_steps_come_from_a_small_table():
    conversation_repair.step.cache_clear()
    r = random.Random(9)
    turns = [(r.choice("suat"), r.choice("bdtkk")) for _ in range(20_000)]
    for state in range(4):
        conversation_repair.walk(turns, state)
    assert conversation_repair.step.cache_info().currsize < 2000


# --- 13 -----------------------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def leaked(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words_of(text)
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[p : p + k])].add("" if item is None else str(item))
    sizes, out = {len(w) for w in windows}, []
    for doc_id, text, *_ in rows:
        w = words_of(text)
        hit, found = set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if s := windows.get(tuple(w[p : p + k])):
                    hit.update(range(p, p + k))
                    found |= s
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leak_rows(seed=4):
    r = random.Random(seed)
    vocabulary = ["a", "b", "the", "word", "ñandú", "x9", "LONGERword", "q"]
    text = lambda n, sep=" ": sep.join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.randint(10, 40))) for k in range(30)] + [(100 + k, text(k + 1)) for k in range(4)] + [(200, "unique short item"), (201, "zebra"), (None, "no id has this item"), (202, None), (203, " .,; ")]
    items += [(5, text(20)), (5, text(20)), (6, items[6][1]), (300, items[7][1].upper().replace(" ", "--")), (301, "common start of a text that many items have and end " + text(3))]
    items += [(400 + k, f"common start of a text that many items have and end {k}") for k in range(50)]
    rows = [(k, text(r.randint(0, 60), r.choice([" ", ", ", "\n"])), "en", "s") for k in range(40)]
    for k in range(30):
        w = items[k][1].split()
        rows.append((1000 + k, f"{text(5)} {'; '.join(w[: r.randint(5, len(w))])}! {text(7)}", "en", "s"))
    rows += [(2000, None, None, None), (None, "Zebra zebra", "en", "s"), (2001, "zebras", "en", "s"), (2002, "unique  SHORT\titem.", "en", "s"), (2002, "unique short item", "en", "s"), (2003, "", "en", "s"), (2004, "no id has this item", "en", "s")]
    rows += [(2005, f"common start of a text that many items have and end {k}", "en", "s") for k in (3, 49, 50)]
    return rows, items


def test_leaks_are_brute_force(spark, docs, rows, empty, monkeypatch):
    more, items = leak_rows()
    benchmark = spark.createDataFrame([(i, t, 1, "y") for i, t in items], "item_id long, text string, doc_id int, n_words string").repartition(2)
    given = documents(spark, more).repartition(3)
    assert sorted(map(tuple, decontamination.decontaminate(given, benchmark).collect()), key=str) == leaked(more, items)
    assert sorted(map(tuple, decontamination.decontaminate(docs, benchmark).collect()), key=str) == leaked(rows, items)
    assert decontamination.decontaminate(empty, benchmark).count() == 0
    assert sorted(map(tuple, decontamination.decontaminate(given, benchmark.limit(0)).collect()), key=str) == leaked(more, [])
    monkeypatch.setattr(decontamination, "SHARD", 2000)  # several passes
    assert sorted(map(tuple, decontamination.decontaminate(given, benchmark).collect()), key=str) == leaked(more, items)


def test_long_items_and_long_texts(spark, monkeypatch):
    r = random.Random(8)
    item = " ".join(f"i{r.randint(0, 50)}" for _ in range(400))
    rows = [(1, " ".join(f"w{r.randint(0, 9)}" for _ in range(400_000)) + " " + item, "en", "s"), (2, item[300:900], "en", "s")]
    assert len(rows[0][1]) > 1 << 20
    monkeypatch.setattr(decontamination, "PIECE", 60)
    assert sorted(map(tuple, decontamination.decontaminate(documents(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()), key=str) == leaked(rows, [(1, item)])


def test_search_skips_and_buckets_decide(monkeypatch):
    r = random.Random(2)
    item = " ".join(f"{r.random()}" for _ in range(40))
    patterns = decontamination.Patterns([("1", decontamination.normal_form(item.encode()))])
    text = decontamination.normal_form(" ".join(f"other{r.random()}" for _ in range(3000)).encode())
    looked = []
    real = decontamination.Class.slots
    monkeypatch.setattr(decontamination.Class, "slots", lambda self, block: looked.append(len(block)) or real(self, block))
    assert [e for _, e, _ in patterns.search([text])] == [[]]
    assert sum(looked) < len(text) * len(patterns.classes) / 20  # most places are never looked at
    own = decontamination.normal_form(item.encode())
    assert [e for _, e, _ in patterns.search([own, text, own])] == [[0, 80], [], [0, 80]]
    monkeypatch.setattr(decontamination.Patterns, "equal", lambda self, data, at, window: np.zeros(len(at), dtype=bool))
    assert [e for _, e, _ in patterns.search([own])] == [[]]


def test_lanes_meet_without_gaps(monkeypatch):
    more, items = leak_rows(7)
    forms = [decontamination.normal_form((t or "").encode()) for _, t, *_ in more]
    pieces = [(str(i), f) for i, t in items if (f := decontamination.normal_form((t or "").encode()))]
    whole = list(decontamination.Patterns(pieces).search(forms))
    monkeypatch.setattr(decontamination, "LANE", 13)
    assert list(decontamination.Patterns(pieces).search(forms)) == whole
