"""Conversation repair, source mix and filter audit against brute force and on odd tables; exact links; hidden data."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from counterpane.llm import conversations, filter_audit, mixture, near_dup, pii, queries

SF = "/root/testdata/sf0.01"
SPACE = " \t\n\x0b\x0c\r"


def run_sql(name, **tables):
    """The SQL counterpart of a query over pandas tables."""
    con = duckdb.connect()
    for table, rows in tables.items():
        con.register(f"{table}_rows", rows)
        con.execute(f"create view {table} as select * from {table}_rows")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)


def rows_of(df):
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return sorted((tuple(r[i] for i in order) for r in df.collect()), key=repr)


# --- conversations --------------------------------------------------------------------------------------------------

PREFIX = re.compile("s?(ua)*u?")


def cheapest(kinds):
    """All edits of few rows `(initial, must go, truncated)`: least cost, then least audit."""
    best = None

    def inserted(roles, cost, audit):
        for m in range(4):
            for more in itertools.product("ua", repeat=m):
                if PREFIX.fullmatch(roles + "".join(more)):
                    yield roles + "".join(more), cost + 3 * m, audit + "I" * m

    def walk(i, roles, cost, audit):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for r, c, a in inserted(roles, cost, audit):
            if i == len(kinds):
                if re.fullmatch("(s?(ua)+)?", r):
                    best = min(best or (c, a), (c, a))
                continue
            initial, gone, cut = kinds[i]
            ways = [(r, 4, "D")] if gone else [(r, 4, "D"), (r + initial, 3 * cut, "K"), (r + "u", 3 + 3 * cut, "R"), (r + "a", 3 + 3 * cut, "R")]
            for roles_, more, letter in ways:
                if PREFIX.fullmatch(roles_):
                    walk(i + 1, roles_, c + more, a + letter)

    walk(0, "", 0, "")
    return best


def test_parser_against_all_edits():
    rng = random.Random(3)
    for _ in range(300):
        kinds = [(rng.choice("suuaa?"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 5))]
        talk = conversations.Talk()
        for initial, gone, cut in kinds:
            talk.read(4 * conversations.INITIALS.index(initial) + 2 * cut + gone)
        assert talk.finish() == cheapest(kinds), kinds


def test_long_talk_in_linear_time():
    talk, start = conversations.Talk(), time.time()
    for _ in range(60_000):  # all rows by the user: two rival repairs stay alive to the end
        talk.read(4)
    cost, audit = talk.finish()
    assert cost == 3 * 30_000 and len(audit) == 60_000 and set(audit) == {"K", "R"}
    assert time.time() - start < 20


TALKS = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, None, "system", "Be kind."),
         (2, 3, None, None), (2, 9, "", "x"), (None, 1, "user", "cut"), (None, 2, "assistant", "Yes!"), (None, None, None, "\t\n"),
         (3, None, "tool", "No turn?"), (3, None, "user", "Why?"), (4, 5, "user", "a" * 300_000 + " " * 300_000), (5, -3, "system", "é."),
         (6, 1, "user", "A."), (6, 4, "user", "A."), (6, 7, "assistant", "B."), (7, 2, "assistant", "  "), (8, 1, "user", "Same.")]
TALKS += [(9 + i // 7, i % 7, random.Random(i).choice(["user", "assistant", "system"]), random.Random(-i).choice(["Yes.", "No", "", "Why?"]))
          for i in range(280)]


def talk_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, digest string, kind int, part string")


def test_report_equals_sql(spark):
    table = talk_table(spark, TALKS).repartition(5)
    got = rows_of(conversations.repair_report(conversations.damage(table), table))
    assert got == run_sql("op11_conversation_repair", conversations=table.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))


def test_repaired_turns_obey_the_grammar(spark):
    table = conversations.damage(talk_table(spark, TALKS))
    report = {r.conv_id: r for r in conversations.repair_report(table).collect()}
    turns = defaultdict(list)
    for r in conversations.repaired_turns(table).orderBy("position").collect():
        turns[r.conv_id].append(r)
    for conv, r in report.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns[conv]))
        assert "".join(t.edit for t in turns[conv]) == r.audit.replace("D", "")
        whole = "\n".join(f"{t.role}:{t.text}" for t in turns[conv])
        assert hashlib.sha256(whole.encode()).hexdigest() == r.repaired_sha256


def test_no_conversations(spark):
    none = talk_table(spark, TALKS).where("turn > 1000")
    assert conversations.repair_report(conversations.damage(none), none).count() == 0
    dropped = talk_table(spark, [(i, 0, "user", "Hi.") for i in range(60) if zlib.crc32(f"{i}:0".encode()) % 20 == 0])
    for r in conversations.repair_report(conversations.damage(dropped), dropped).collect():
        assert (r.gaps, r.cost, r.audit, r.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())


# --- mix ------------------------------------------------------------------------------------------------------------

def mix_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows],
                                 "doc_id bigint, source string, text string, size int, target string, no int")


def mixed_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, "big", "w " * rng.randint(0, 60)) for i in range(400)]
    rows += [(1000 + i, f"s{i % 5}", " ".join(["v"] * rng.randint(0, 30))) for i in range(60)]
    return rows + [(2000, None, "a b c"), (2001, "", None), (2002, "tiny", "one two"), (None, "tiny", "x"), (2002, "tiny", "one two"),
                   (2003, "long", "z " * 50_000), (2004, "empty", ""), (2005, "é", "\x1cstill\x1cone\x1cword")]


def test_mix_equals_sql_and_meets_its_targets(spark):
    table = mix_table(spark, mixed_rows())
    mix = mixture.mix_sources(table)
    assert rows_of(mix) == run_sql("op12_source_mix", documents=table.toPandas().astype({"doc_id": "Int64"}))
    plan = mixture.mix_plan(table).collect()
    sums, total = Counter(), sum(r["size"] for r in plan)
    for r in plan:
        sums[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    targets = {r.source: r.target for r in plan}
    assert sum(targets.values()) == pytest.approx(total)
    for source, target in targets.items():
        assert abs(sums[source] - target) <= max(1, 2 * plan[0].block), source


def test_mix_of_many_shards_and_its_texts(spark):
    table = mix_table(spark, [r for r in mixed_rows(5) if r[0] is not None and r[0] < 2000])
    plan = mixture.mix_plan(table, shard_docs=50, block=16).collect()
    assert len({r.shard for r in plan if r.source == "big"}) == 8
    sums, targets = Counter(), {r.source: r.target for r in plan}
    for r in plan:
        sums[r.source] += r.taken
    for source, target in targets.items():
        assert abs(sums[source] - target) <= 16 * 9, source
    words = Counter()
    for r in mixture.mixed_texts(table, shard_docs=50, block=16).collect():
        words[r.doc_id] += len([w for w in re.split(f"[{SPACE}]+", r.text) if w])
    assert words == Counter({r.doc_id: r.taken for r in plan if r.taken})


def test_apportionment_by_highest_quotients(spark):
    rng = random.Random(2)
    for trial in range(3):
        votes = {k: rng.choice([0.0, 1.0, 2.5, 100.0, 1000.0 * rng.random()]) for k in range(12)}
        seats = rng.randint(0, 90)
        ranked = sorted(((-v / (2 * k + 1), unit, k) for unit, v in votes.items() if v > 0 for k in range(seats)))[:seats]
        want = Counter(unit for _, unit, _ in ranked)
        df = spark.createDataFrame([(u, v, seats) for u, v in votes.items()], "unit int, votes double, seats int")
        got = {r.unit: r.quota for r in mixture.apportion(df, [], "unit", "votes", "seats").collect() if r.quota}
        assert got == dict(want)


def test_empty_mix(spark):
    none = mix_table(spark, mixed_rows()).where("doc_id > 9999")
    assert mixture.mix_sources(none).count() == 0
    blank = mix_table(spark, [(1, "a", None), (2, None, " ")])
    assert [(r["size"], r.target, r.taken) for r in mixture.mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


# --- audit ----------------------------------------------------------------------------------------------------------

def test_audit_equals_sql(spark):
    rng = random.Random(4)
    texts = [None, "", "A" * 500_000, "word " * 120, "a b", "a b", "A$ b", " ".join(f"w{i}" for i in range(150))]
    rows = [(rng.choice([None, *range(20)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(120)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, part string, rid int")
    labels = spark.createDataFrame([(i, rng.choice([None, 0, 1]), rng.choice([0, 1])) for i in [*range(15), 3, 4]]
                                   + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = rows_of(filter_audit.audit_filters(docs, labels))
    assert got == run_sql("op13_filter_audit", documents=docs.toPandas().astype({"doc_id": "Int64"}),
                          labels=labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    assert len(got) == 3 * 600
    assert filter_audit.audit_filters(docs.where("doc_id > 99"), labels).count() == 0


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([(i, "p") for i in range(10)], "rid bigint, part string")
    fails = {"X": [1, 2, 3], "Y": [3, 4], "Z": []}
    tables = {f: spark.createDataFrame([(i, "p", 1, 0) for i in ids], "rid bigint, part string, good int, toxic int") for f, ids in fails.items()}
    got = {(r.filter_order, r.step): r for r in filter_audit.audit(rows, tables).collect()}
    assert len(got) == 18
    assert (got["YXZ", 2].removed, got["YXZ", 2].redundant, got["YXZ", 2].kept, got["YXZ", 2].unique_fails) == (2, 1, 6, 2)
    assert got["XYZ", 1].shapley == 3 * 3 + 2 * 3


# --- exact links and hidden data ------------------------------------------------------------------------------------

def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_linear_hashes_confuse():
    a, b = "x" * 4096, "y" * 4096
    one, two = thue_morse(1024), thue_morse(1024).translate(str.maketrans("ab", "ba"))
    sets = near_dup.Shingles(3).sets([f"{a}{b} p q", f"{b}{a} p q", f"{one} p q", f"{two} p q", "p q " + one])
    assert len({int(s[0]) for s in sets}) == 5


def test_equal_digests_of_different_sets_are_told_apart(spark, monkeypatch):
    texts = [f"alpha beta gamma {w} delta" for w in ("one", "two", "three")] + ["alpha beta gamma one delta"]
    table = spark.createDataFrame(list(enumerate(texts)), "rid bigint, text string")
    members = spark.createDataFrame([(i, 0, hot) for i, hot in enumerate([True, True, True, True])], "rid bigint, rep bigint, hot boolean")
    assert {r.rid for r in near_dup.unequal(members, table, 3).collect()} == {1, 2}
    cold = members.selectExpr("rid", "rep", "false as hot")
    assert {r.rid for r in near_dup.unequal(cold, table, 3).collect()} == {1, 2}


def hidden(text):
    return {(k, text[a:b]) for k, a, b in pii.hidden_spans(text, pii.base_spans(text))}


@pytest.mark.parametrize("unit", ["a dot ", "a.b", "a at ", "x-at-", " (at) ", "a@ ", " " * 50 + "at"])
def test_signs_without_end_cost_linear_time(unit):
    start = time.time()
    pii.hidden_spans(unit * (1_000_000 // len(unit)), [])
    assert time.time() - start < 15


DISGUISES = [("email", "john.smith at mail dot example dot org"), ("email", "jоhn@example.com"), ("email", "mary [at] host [dot] net"),
             ("email", "bob_at_host_dot_com"), ("email", "kim&#64;site&#46;org"), ("ip", "192 dot 168 dot 1 dot 1"),
             ("ip", "10[.]0[.]0[.]1"), ("phone", "+4 nine 1 2 3 4 5 6 seven 8 9"), ("card", "4l11 1111 1111 1111")]


def test_planted_disguises_are_found(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(200).collect() if r.text]
    found = sum((kind, plant) in hidden(f"{text[:400]} | {plant} | {text[400:600]}")
                for i, text in enumerate(docs) for kind, plant in [DISGUISES[i % len(DISGUISES)]])
    assert found >= 0.95 * len(docs)
