"""Conversation repair, the permutation index and the filter audit against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import harness  # noqa: E402

from tidewell.llm import ann, audit, dialogue, queries  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)} by recursion from the end over (cost, audit) pairs."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        h = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        by[conv]  # noqa: B018
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, found in by.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in found:
            said = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        n = len(found)
        follow = {"": "u", "s": "u", "a": "u", "u": "a"}

        @cache
        def best(i, node, put, found=found, faults=faults, n=n, follow=follow):
            can = [(0, "")] if i == n and node in ("", "a") else []
            if put < 3:
                c, a = best(i, follow[node], put + 1)
                can.append((c + 3, "I" + a))
            if i < n:
                c, a = best(i + 1, node, 0)
                can.append((c + 4, "D" + a))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    c, a = best(i + 1, follow[node], 0)
                    can.append((c + 3 + more, "R" + a))
                    initial = found[i][1][:1]
                    if initial == follow[node] or initial == "s" and node == "":
                        c, a = best(i + 1, initial, 0)
                        can.append((c + more, "K" + a))
            return min(can, default=(10**9, ""))

        sys.setrecursionlimit(100_000)
        cost, told = best(0, "", 0)
        lines, node, i = [], "", 0
        for letter in told:
            if letter == "D":
                i += 1
                continue
            node = found[i][1][:1] if letter == "K" else follow[node]
            role = found[i][1] if letter == "K" else {"u": "user", "a": "assistant"}[node]
            lines.append(f"{role}:{'' if letter == 'I' else found[i][2]}")
            i += letter != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        turns = {t for t, *_ in found if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, told, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(r: random.Random, n: int, longest: int):
    rows = []
    for conv in range(n):
        k, at = r.randint(1, longest), 0
        for i in range(k):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", "", None] if r.random() < 0.3 else [("user", "assistant")[i % 2]])
            text = r.choice(["Yes.", "No!", "a b\nc?", "cut off", " ", "", None, "é.", f"line {r.randint(0, 5)}.\t"])
            rows.append((conv, None if r.random() < 0.03 else at, role, text))
            at += r.choice([1, 1, 1, 1, 2, 0, 5])
    return rows


def told(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repairs_are_the_cheapest_and_first(spark):
    rows = [*conversations(random.Random(3), 300, 9), *[(None, t, "user", "x.") for t in range(5)], (7000, 0, "user", "same."), (7000, 0, "user", "same."), (7001, None, None, None)]
    dropped = next(i for i in range(8000, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    random.Random(4).shuffle(rows)
    turns = spark.createDataFrame(rows, TURNS).select("*", *[F.lit(1).alias(c) for c in ("cost", "audit", "lead", "there", "same", "again", "harm", "of")]).repartition(5)
    want = plain_repair(rows)
    assert told(dialogue.digests(*dialogue.repair(turns))) == want
    assert want[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and None in want


def test_long_conversations_take_blocks(spark):
    r = random.Random(5)
    rows = [(1, i, r.choice(["user", "assistant"]), r.choice(["Yes.", f"No {i}!", "cut", f"again {i}"])) for i in range(700)]
    rows += [(2, i, "user", f"{i}.") for i in range(300)] + [(3, i, ("user", "assistant")[i % 2], "the same.") for i in range(400)]
    got = dialogue.digests(*dialogue.repair(spark.createDataFrame(rows, TURNS)))
    assert told(got) == plain_repair(rows)


def test_repaired_rows_follow_their_audit(spark):
    rows = conversations(random.Random(6), 60, 7)
    damaged, found = dialogue.repair(spark.createDataFrame(rows, TURNS))
    lines, edits = defaultdict(list), defaultdict(str)
    for x in dialogue.repaired(damaged, found).orderBy("conv_id", "place").collect():
        lines[x.conv_id].append(f"{x.role}:{x.text}")
        edits[x.conv_id] += x.edit
        assert x.place == len(lines[x.conv_id])
    for conv, (*_, audit_, sha) in plain_repair(rows).items():
        assert edits[conv] == audit_.replace("D", "") and hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == sha


def test_no_conversations(spark, sf_dir):
    empty = spark.createDataFrame([], TURNS)
    assert dialogue.digests(*dialogue.repair(empty)).count() == 0
    assert dialogue.repaired(*dialogue.repair(empty)).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(queries.op11_conversation_repair(spark, sf_dir)) == plain_repair(rows)


def plain_nearest(rows, every, k=20):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (v * v[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found_by(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return dict(out)


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("dim", [8, 64])
def test_most_neighbours_are_found(spark, dim):
    r = np.random.default_rng(dim)
    v = r.normal(size=(6000, dim))
    v[:2000] = v[0] + 0.05 * v[:2000]  # a third of all rows are near copies
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = list(enumerate(v.astype(np.float32).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    want = plain_nearest([(i, np.float32(x)) for i, x in rows], 20)
    got = found_by(ann.nearest(df, F.col("vec_id") % 20 == 0))
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(math.isclose(s, float((v.astype(np.float32)[i].astype(float) * v.astype(np.float32)[q].astype(float)).sum()), abs_tol=1e-12) for i, s in found)
    fewer = found_by(ann.nearest(df, F.col("vec_id") % 20 == 0, share=4))
    assert recall(fewer, want) > 0.3


def test_all_neighbours_of_few_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = found_by(queries.op12_permutation_index(spark, sf_dir)), plain_nearest(rows, 20)
    assert recall(got, want) >= 0.9 and set(got) == set(want)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [None, 1.0]), (9, []), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [0.5, 0.5]), (3, [0.4, 9.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "pivots", "cell", "row", "score", "rank", "own", "other")})
    assert found_by(ann.nearest(df, F.col("vec_id") % 20 == 0)) == {20: [(1, 1.0), (2, 1.0), (3, float(np.float32(0.4)))]}
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000)], "vec_id long, embedding array<float>")
    got = found_by(ann.nearest(copies, F.col("vec_id") % 20 == 0, 5, share=1))
    assert all([i for i, _ in x] == [i for i in range(6) if i != q][:5] for q, x in got.items())
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(copies.where("vec_id = 7"), F.col("vec_id") % 7 == 0).count() == 0


def plain_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    last = float("inf")
    first = {}
    for i, text, _ in docs:
        first[text or ""] = min(first.get(text or "", last), last if i is None else i)
    parts = defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        parts[lang or ""].append((fails + "E" * ((last if i is None else i) > first[t]), i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        total = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in x[0] for x in rows) - len(gone), sum(x[0] == f for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return {k: tuple(x) for k, x in out.items()}


def test_audit_counts_every_order(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    docs = []
    for i in range(120):
        text = " ".join(r.choice(words[: r.choice([5, 300])]) for _ in range(r.choice([20, 199, 200, 400])))
        text = text.upper() if r.random() < 0.2 else text
        docs.append((i, text + r.choice(["", "", " #", " 50%"]), r.choice(["en", "de", "", None])))
    docs += [(200 + i, docs[i % 7][1], "en") for i in range(60)] + [(300, None, "fr"), (301, "", "fr"), (301, "", "de"), (None, docs[1][1], "en"), (None, "only here", None), (None, "only here", None), docs[3], docs[3], (-5, docs[2][1], None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (10**6, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("part", "bits", "same", "good", "n", "step", "first", "stay")}).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in audit.audit(df, marks).collect()}
    assert got == plain_audit(docs, labels)
    assert audit.audit(df.limit(0), marks).count() == 0
    assert {x.good_lost for x in audit.audit(df, marks.limit(0)).collect()} == {0}


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_filter_audit"])
def test_query_has_the_rows_of_its_sql(spark, sf_dir, name):
    assert not harness.check(spark, name, queries.QUERIES[name], queries.SQL[name], sf_dir)
