"""The document operators against brute force, round trips and held-out labels, and their behaviour on odd tables."""

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from counterpane.llm import (bpe, decontaminate, exact_dedup, language, line_dedup, near_dup, pii, quality, queries,
                             token_count, toxicity)

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PROSE = ("The quick brown fox jumps over the lazy dog, and then it sleeps. Nobody saw it happen; the garden was empty, "
         "the evening quiet. Somewhere a clock struck nine, and a window closed. ")


def docs_of(spark, rows):
    """A table with columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3.0, True) for i, t in rows],
                                 "doc_id bigint, text string, rid string, gid int, n int, score double, kept boolean")


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def words(n, seed, size=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


ODD = [(1, None), (2, ""), (None, "no id here"), (3, "  \n\t "), (4, "same text"), (4, "same text"), (5, "same text"),
       (6, "é" * 7 + " " + "z" * 200_000), (7, words(3000, 1))]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, []).where("doc_id > 0")


# --- byte-level BPE -------------------------------------------------------------------------------------------------

def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    signs = " \t\n\r\x0b\x0c\x1c\x85\xa0 　'sStTrReEvVmMlLdDabAB0129.,!?-éñ中文😀́​"
    return ["", "a", " ", "  a", "a  b ", "a" * 700, " " * 300 + "x"] + [
        "".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_merge_replay_equals_the_library():
    want, own = reference_encoding(), bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = odd_texts(3000)
    for text, ids in zip(texts, own.encode(texts)):
        assert [int(x) for x in ids.split()] == want.encode_ordinary(text), repr(text)


def test_merge_replay_when_an_earlier_rank_comes_up():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"bc": 258, b"ab": 257, b"abcab": 259, b"cab": 260}
    own = bpe.Encoder(ranks, r"\S+|\s+")
    want = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        assert [int(x) for x in next(iter(own.encode([text]))).split()] == want.encode_ordinary(text)


def test_encode_and_decode(spark, odd, none):
    encoded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, RANKS).collect()
    assert sorted(r.bytes.decode() for r in back) == sorted(t or "" for _, t in ODD)
    want = reference_encoding()
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in bpe.digests(odd, RANKS, public_tokenizers.PATTERN).collect()}
    for doc_id, text in ODD:
        ids = want.encode_ordinary(text or "")
        assert (doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256((text or "").encode()).hexdigest()) in got
    assert bpe.digests(none, RANKS, public_tokenizers.PATTERN).count() == 0


# --- token counts ---------------------------------------------------------------------------------------------------

def test_token_counts_equal_the_library(spark, odd, none):
    tokenizer = Tokenizer.from_file(JSON)
    rows = ODD + list(enumerate(odd_texts(800) + ["<|endoftext|>", "x<|endoftext|> y <|endoftext|>z"], 100))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit)
                 for r in token_count.count_tokens(docs_of(spark, rows), JSON).collect())
    want = sorted((i or -1, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids),
                   n > 512) for i, t in rows)
    assert got == want
    assert token_count.count_tokens(none, JSON).count() == 0


# --- exact duplicates -----------------------------------------------------------------------------------------------

def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(str(i), str(keep), len(members), i == keep, hashlib.sha256(body.encode()).hexdigest())
                for i, _ in members]
    return sorted(out)


def test_exact_groups(spark, odd, none):
    long = words(40_000, 3)
    rows = ODD + [(20, long), (21, long + "\n"), (22, long + "x"), (23, "y" + long)] + [
        (i, "a" * 64) for i in range(30, 34)] + [(40, "a" * 320), (41, "a" * 321), (42, "a " * 320)]
    got = exact_dedup.exact_groups(docs_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == exact_brute(rows)
    assert exact_dedup.exact_groups(none).count() == 0


def test_hot_groups_are_salted(spark, monkeypatch):
    from counterpane.llm import common

    rows = [(i, "the same text in very many rows") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(50)]
    monkeypatch.setattr(common, "HOT", 4)
    got = exact_dedup.exact_groups(docs_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == exact_brute(rows)


# --- near duplicates ------------------------------------------------------------------------------------------------

def near_brute(rows, size=3, percent=85):
    sets = [near_dup.shingle_set(t or "", size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(sets[k]), str(least.get(root(k))), i == least.get(root(k)))
                  for k, (i, _) in enumerate(rows))


def near_rows():
    rng = random.Random(8)
    rows, doc = list(ODD), 100
    for _ in range(6):
        base = words(120, rng.random()).split()
        for _ in range(14):  # edits of 0 to 9 words: many pairs close to the threshold
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = "edited" + str(rng.randint(0, 99))
            rows.append((doc, " ".join(copy)))
            doc += 1
    return rows + [(doc + k, words(60, k)) for k in range(20)] + [(900, "one"), (901, "ONE "), (902, "one two")]


def test_near_duplicates_equal_brute_force(spark, none):
    rows = near_rows()
    got = near_dup.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == near_brute(rows)
    assert near_dup.near_duplicates(none).count() == 0


def test_shingle_hashes_are_the_exact_sets():
    texts = ["", "a", "a b", "A B c", "a b c d", " \n ", "x\ty z w x y z", "É é x", "w" * 9000 + " v u", PROSE]
    for size in (3, 5):
        assert [len(s) for s in near_dup.Shingles(size).sets(texts)] == [len(near_dup.shingle_set(t, size)) for t in texts]


def test_signature_is_circulant():
    import numpy as np

    signatures, rng = near_dup.Signatures(4, 2), np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    at = signatures.scatter[(hashes & np.uint64(near_dup.UNIVERSE - 1)).astype(np.int64)]
    table = signatures.windows[:, 0]
    for k in range(8):  # coordinate k is the minimum over the second permutation shifted by k
        assert signatures.windows[at].min(axis=0)[k] == min(table[(a + k) % near_dup.UNIVERSE] for a in at)


# --- line dedup -----------------------------------------------------------------------------------------------------

def test_lines_join_to_the_text(spark, odd):
    rows = odd.where("text is not null").select("text", F.array_join(line_dedup.lines_of(F.col("text")), "").alias("t"))
    assert all(r.text == r.t for r in rows.collect())


def test_repeated_passages_go_but_once(spark, none):
    passage = words(70, 99).replace(" k", ", k").replace("a ", "a. ")
    rows = [(i, f"{words(40, i)} {passage} {words(40, 1000 + i)}") for i in range(12)]
    rows += [(50, words(200, 50)), (51, words(90, 51) + "\n" + words(90, 52)), (60, None), (61, ""),
             (62, rows[3][1]), (62, rows[3][1])]
    got = line_dedup.remove_repeats(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    inner = " ".join(passage.split()[12:-12])
    assert sum(inner in (r.text or "") for r in got) == 1
    by_id = {r.doc_id: r for r in got}
    for i in (50, 51, 61):
        assert by_id[i].text == dict(rows)[i] and by_id[i].n_removed == 0
    assert by_id[60].text is None
    for r in got:  # what surrounds the passage stays
        if r.doc_id < 12:
            assert r.text.startswith(words(40, r.doc_id)[:60]) and r.text.endswith(words(40, 1000 + r.doc_id)[-60:])
    assert line_dedup.remove_repeats(none).count() == 0


def test_no_line_is_lost_for_good(spark):
    before = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    after = {r.doc_id: r.text for r in line_dedup.remove_repeats(table(spark, "documents")).collect()}
    cut = re.compile(line_dedup._ENDS)
    lines = [{x.rstrip(" \n\t\r") for t in side.values() for x in cut.split(t)} for side in (before, after)]
    assert lines[0] - lines[1] <= {""}

    def repeats(texts):
        seen = defaultdict(set)
        for i, t in texts.items():
            w = t.split()
            for k in range(len(w) - 49):
                seen[tuple(w[k:k + 50])].add(i)
        return sum(len(v) - 1 for v in seen.values())

    assert repeats(after) < 0.02 * repeats(before)


def test_short_passages_are_found_one_by_one(spark):
    """Passages of 51 to 60 words, each in two documents of its own: every one goes from the later document."""
    table = [words(51 + k % 10, 5000 + k) for k in range(200)]
    rows = [(2 * k + n, f"{words(40, 9000 + 2 * k + n)} {p} {words(40, 19000 + 2 * k + n)}")
            for k, p in enumerate(table) for n in (0, 1)]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    inner = [" ".join(p.split()[12:-12]) for p in table]
    assert all(p in got[2 * k] for k, p in enumerate(table))
    assert [k for k, p in enumerate(inner) if p in got[2 * k + 1]] == []


def plain(n, seed, wide=False):
    """Short words without marks, or text of one script without blanks."""
    rng = random.Random(seed)
    if wide:
        return "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 5))) for _ in range(n))


@pytest.mark.parametrize("wide, size, near", [(False, 60, 30), (True, 240, 60)])
def test_text_without_line_ends_is_compared(spark, wide, size, near):
    table = [plain(size, 7000 + k, wide) for k in range(60)]
    gap = "" if wide else " "
    rows = [(2 * k + n, gap.join([plain(near, 100 * k + n, wide), p, plain(near, 100 * k + 50 + n, wide)]))
            for k, p in enumerate(table) for n in (0, 1)]
    whole = plain(3000, 999999, wide)
    rows += [(998, whole), (999, whole)]
    got = {r.doc_id: r.text for r in line_dedup.remove_repeats(docs_of(spark, rows)).collect()}
    assert got[998] == whole and got[999] == ""
    assert all(p in got[2 * k] for k, p in enumerate(table))
    assert [k for k, p in enumerate(table) if p[60:-60] in got[2 * k + 1]] == []


# --- decontamination ------------------------------------------------------------------------------------------------

def edited(text, n, rng):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(1, len(out) - 1)
        kind = rng.random()
        if kind < 0.4:
            out[k] = "q"
        elif kind < 0.7:
            out.insert(k, "q")
        else:
            del out[k]
    return "".join(out)


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        prior, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            prior, row[j] = row[j], min(prior + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_contamination_equals_full_alignment(spark, odd, none):
    rng = random.Random(3)
    items = [(i, words(18, 500 + i)) for i in range(6)] + [(6, None), (7, "short"), (8, words(18, 500)), (9, words(5, 3) * 2)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = list(ODD)
    for k in range(60):
        i = rng.randrange(6)
        rows.append((100 + k, f"{words(20, k)} {edited(items[i][1], rng.randint(0, 16), rng)} {words(20, 300 + k)}".upper()))
    rows += [(300 + k, words(80, 700 + k)) for k in range(20)]
    windows = decontaminate.Windows.of((i, t) for i, t in items if t is not None)
    want = {}
    for doc, text in rows:
        body = decontaminate.normalise(text or "")
        if len(body) < 5000:
            want[doc] = sorted({int(i) for t, i, k in zip(windows.texts, windows.items, decontaminate.budget(windows.sizes))
                                if least_edits(t, body) <= k})
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs_of(spark, rows), bench).collect()}
    for doc, found in want.items():
        assert list(got[doc]["items"]) == found and got[doc].kept == (not found), doc
    assert 20 < sum(bool(f) for f in want.values()) < 60
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(odd, bench.limit(0)).where("kept").count() == len(ODD)


def test_contamination_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, words(30, i)) for i in range(40)], "item_id bigint, text string")
    rows = docs_of(spark, [(i, words(30, i) if i % 2 else words(30, 900 + i)) for i in range(40)])
    whole = sorted(map(str, decontaminate.find_contamination(rows, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert sorted(map(str, decontaminate.find_contamination(rows, items).collect())) == whole
    assert decontaminate.keep_clean(rows, items).count() == 20


def test_short_items_are_found_verbatim(spark):
    rng = random.Random(11)
    signs = ["a", "b", "ab", "aé", "who", "wrote", "iliad", "of the", "x" * 29, "x" * 31]
    items = [(i, " ".join(rng.choice(signs) for _ in range(rng.randint(1, 4)))) for i in range(60)]
    items += [(90, "Who wrote the Iliad?"), (91, "who WROTE the iliad"), (92, "?!"), (93, ""), (None, "null id"), (94, None)]
    rows = [(i, " ".join(rng.choice(signs) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    rows += [(900, "Tell me: who wrote the ILIAD, please"), (901, "xwho wrote the iliad"), (902, "who wrote the iliads"),
             (903, "who wrote"), (904, None), (905, "?!"), (906, "who wrote the iliad")]
    short = {}
    for i, t in sorted((i, t) for i, t in items if i is not None and t is not None):
        body = decontaminate.normalise(t)
        if 0 < len(body) < decontaminate.MIN_BYTES:
            short.setdefault(body, i)
    found = decontaminate.find_contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r.doc_id: set(r["items"]) & set(short.values()) for r in found.collect()}
    for doc, text in rows:
        body = b" " + decontaminate.normalise(text or "") + b" "
        assert got[doc] == {i for t, i in short.items() if b" " + t + b" " in body}, text
    assert 90 in got[900] and 90 in got[906] and not {90, 91} & (got[901] | got[902] | got[903])


def test_parts_of_the_expansion_lose_nothing(monkeypatch):
    rng = random.Random(12)
    items = [(i, words(18, 500 + i)) for i in range(6)] + [(7, "ab " * 60), (8, "a" * 200), (9, "ab " * 30 + words(10, 4))]
    windows = decontaminate.Windows.of(items)
    texts = [f"{words(5, k)} {edited(items[rng.randrange(9)][1], rng.randint(0, 12), rng)} {words(9, 40 + k)}" for k in range(40)]
    texts += ["", "a", "ab " * 300, "a" * 3000]
    whole = decontaminate.contaminated(texts, windows)
    assert sum(bool(f) for f in whole) > 10
    for entries in (20, 5000):
        monkeypatch.setattr(decontaminate, "ENTRIES", entries)
        assert decontaminate.contaminated(texts, windows) == whole


def test_items_that_share_a_stem_take_bounded_memory():
    stem = words(9, 77)[:44]
    windows = decontaminate.Windows.of((i, f"{stem} {words(9, 5000 + i)}") for i in range(20_000))
    hit = windows.texts[123].decode()
    tracemalloc.start()
    found = decontaminate.contaminated([f"{words(300, 8)} {stem} {words(300, 9)}", f"{words(90, 10)} {hit}"], windows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not found[0] and int(windows.items[123]) in found[1]
    assert peak < 500 << 20


def test_blocks_of_repeated_items_count_once(spark, odd, monkeypatch):
    items = [(i, words(30, i % 20).upper() if i > 19 else words(30, i) + "!") for i in range(40)] + [(50, "same text")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = docs_of(spark, [(i, words(30, i)) for i in range(20)]).unionByName(odd)
    whole = sorted(map(str, decontaminate.find_contamination(rows, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert sorted(map(str, decontaminate.find_contamination(rows, bench).collect())) == whole
    kept = decontaminate.keep_clean(rows, bench)
    # document 7 begins with the words of item 1
    assert kept.columns == rows.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "6", "None"]


# --- personal data --------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (
                    kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits))) or (
                    kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for signs, least in (("ab1.2@+- ()4é%", 0), ("0123456789 -.+", 10)):
        for _ in range(8000):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(least, 60)))
            assert pii.base_spans(text) == base_brute(text), text


@pytest.mark.parametrize("kind,hidden", [
    ("email", "john dot doe at mail dot example dot com"), ("email", "bob (at) example (dot) org"),
    ("email", "bob[at]example.org"), ("email", "john@example dot com"), ("email", "jоhn@еxample.com"),
    ("email", "john@exa​mple.com"), ("phone", "plus one four five six five five five two one eight six"),
    ("phone", "+1 (456) 555-21O6"), ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "192[.]168[.]1[.]1"),
    ("card", "４１１１ １１１１ １１１１ １１１１"), ("card", "four" + " one" * 15)])
def test_disguises_map_back(kind, hidden):
    text = f"Écoute, write {hidden} please"
    spans = pii.hidden_spans(text, pii.base_spans(text))
    assert [(k, text[a:b]) for k, a, b in spans] == [(kind, hidden)]


def test_plain_prose_has_nothing_hidden():
    for text in (PROSE, "Look at it. Then at home, one or two or three of us, not four.", "Привет, мир. Это текст о жизни."):
        assert pii.hidden_spans(text, []) == []


def test_personal_data_table(spark, odd, none):
    rows = ODD + [(90, "a@b.cd 1.2.3.4 +1 234 567 8901"), (91, "x" * 100_000 + " " + "7" * 100_000)]
    got = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, rows)).collect()}
    assert got[90].spans == "email:0:6,ip:7:14,phone:15:30" and (got[90].n_email, got[90].n_ip, got[90].n_phone) == (1, 1, 1)
    assert got[90].base_sha256 == hashlib.sha256(got[90].spans.encode()).hexdigest()
    assert got[1].spans == "" and got[91].spans == ""
    assert pii.find_personal_data(none).count() == 0


# --- learned scores -------------------------------------------------------------------------------------------------

def test_toxicity_folds_and_spares():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot"): 3.0}, ("idiot proof",), -3.0, 4.0)
    built = toxicity.automaton(lexicon)
    for text in ("you 1d10t", "you іdіоt", "you ID1OT", "you id​iot"):
        assert len(toxicity.find(toxicity.fold(text), built)) == 1, text
    for text in ("an idiot proof plan", "idiotic", "fine words"):
        assert toxicity.find(toxicity.fold(text), built) == []
    assert toxicity.learn([]).intercept == float("-inf")


def test_learning_never_reads_the_held_out_fold(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    sample = toxicity.labelled_sample(docs, labels, "toxic", 5, 0, 2500, 20_000).collect()
    assert sample and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                                               1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn_from(docs, turned) == toxicity.learn_from(docs, labels)


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.95), ("op3_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    row = scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("right"), F.min("score").alias("low"),
                     F.max("score").alias("high")).first()
    assert row.right >= least and 0 <= row.low <= row.high <= 1


def test_language_accuracy(spark):
    docs = table(spark, "documents")
    net = language.learn_from(docs)
    found = language.predict_language(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    odd = {r.doc_id: r for r in language.predict_language(docs_of(spark, ODD + [(90, "123 -- 4")]), net).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3, 90)] == ["und"] * 4 and odd[None].held_out and odd[6].lang_pred != "und"


def test_merged_tables_give_the_same_network(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    windows = rng.integers(1, 255, (6, language.WINDOW)).astype(np.uint8)
    net = language.train(windows, np.array([0, 1, 0, 1, 0, 1]), ["a", "b"])
    assert np.allclose(net.log_probabilities(net.hidden(windows)[0]), language.Predictor(net).window_scores(windows), atol=1e-4)


def test_scores_of_odd_tables(spark, odd, none):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rules, lexicon = quality.learn_from(docs, labels), toxicity.learn_from(docs, labels)
    for got in (quality.score_quality(odd, rules), toxicity.score_toxicity(odd, lexicon)):
        rows = got.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert all(r.held_out for r in rows if r.doc_id is None)
    assert quality.score_quality(none, rules).count() == toxicity.score_toxicity(none, lexicon).count() == 0
    nothing = quality.learn_from(docs, labels.limit(0))
    assert quality.score_quality(odd, nothing).agg(F.max("score")).first()[0] < 1e-6
    assert toxicity.score_toxicity(odd, toxicity.learn_from(docs, labels.limit(0))).agg(F.max("score")).first()[0] == 0
    assert language.predict_language(odd, language.learn_from(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_rules_as_columns_give_the_learned_values(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rules = quality.learn_from(docs, labels)
    rows = quality.statistics(docs.select("doc_id", "text")).withColumn("own", rules.column()).toPandas()
    assert abs(rows["own"] - rules.values(rows[list(quality.STATISTICS)].to_numpy())).max() < 1e-9
    assert 0 < len(rules.weights) < 150


# --- queries and pipeline -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline_stages(spark):
    docs = table(spark, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in kept.collect()}
        assert after.keys() <= before.keys()
        if name == "near_dedup":
            rows = [(i, t) for i, t in sorted(before.items())]
            want = near_brute(rows, 5, 80) if len(rows) < 400 else None
            groups = {c for _, _, c, _ in want} if want else None
            assert len(after) <= len(before) and (groups is None or len(after) == len(groups))
        if name == "line_dedup":
            assert after.keys() == before.keys()
            assert all(r.n_chars == len(r.text) for r in kept.collect())
        if name == "decontamination":
            items = [decontaminate.normalise(r.text) for r in table(spark, "benchmark").collect()]
            gone = before.keys() - after.keys()
            assert all(any(x in decontaminate.normalise(before[i]) for x in items) is False for i in after)
            assert len(gone) < 0.2 * len(before)
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_first_rows_are_those_of_one_order_by_hash(spark):
    from pyspark.sql import Window

    from counterpane.llm.common import first_rows
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    rows = rows.unionByName(spark.createDataFrame([(None, 0), (5, None), (9000, None)], "doc_id bigint, y int"))
    for most in (1, 50, 5000):
        place = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id"))
        want = rows.withColumn("place", place).where(F.col("place") <= most).drop("place")
        assert sorted(map(str, first_rows(rows, "y", most).collect())) == sorted(map(str, want.collect()))
    assert first_rows(rows.limit(0), "y", 5).count() == 0
