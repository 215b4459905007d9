"""Each operator against a brute-force version on a small table of hard cases: NULLs, empty and long texts, ties,
repeated rows, white space of all kinds, and extra columns whose names clash with results."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from framequery.llm import bpe, byte_repeats, components, decontaminate, hmm, pages, passages, quality, repeats, simhash, token_files, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_words string, shard string, fp string"


def corpus():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 8))) for _ in range(300)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts = [None, "", "   \t\n", "one", "two words", "A b C", "x\x1cy\x85z ends", "日本 語 テスト " * 3, "<|endoftext|> a<|startoftext|>b", "w" * 5000]
    for k in range(60):
        own = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 200)))
        texts.append(own if k % 3 else f"{own}\n{passage} {own[:50]}")
    texts += [texts[20], texts[20], texts[25] + " tail", passage, passage, " ".join(["same"] * 100), " ".join(rnd.choice(vocabulary) for _ in range(5000))]
    ids = [3 * k for k in range(len(texts))]
    rnd.shuffle(ids)
    return [(i, t, "clash", "clash", "clash") for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd_rows(spark, docs):
    """With a NULL id and a row that is there twice."""
    return docs.unionByName(spark.createDataFrame([(None, "no id here", "", "", ""), (0, "again again", "", "", ""), (0, "again again", "", "", "")], SCHEMA))


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def test_op7_equals_the_library(spark, docs, rows):
    t = library()
    got = {r.doc_id: r for r in bpe.encode_decode(docs, TOKENIZER).collect()}
    digests = {r.doc_id: r for r in bpe.encode_decode_digests(docs, TOKENIZER).collect()}
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert (list(got[i].ids), got[i].decoded, got[i].n_tokens) == (ids, decoded, len(ids))
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_decode(empty(spark), TOKENIZER).count() == 0
    assert bpe.encode_decode(odd_rows(spark, docs), TOKENIZER).count() == len(rows) + 3


def test_op7_pairs_and_exact_merges_agree():
    rnd = random.Random(3)
    b = bpe.word_bpe(TOKENIZER)
    words = [bytes(rnd.choice(b"aabnthe \xc3\xa9") for _ in range(rnd.randint(1, 70))) for _ in range(3000)]
    ids, offsets = b.encode_words(words)
    for k, w in enumerate(words):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == b.merged(w)


def test_op7_plain_letters_agree_with_the_library():
    b = bpe.word_bpe(TOKENIZER)
    chunks = [f"a{chr(c)}B" for c in range(0x21, bpe.PLAIN_BELOW) if chr(c).isprintable() and c not in (0x85, 0xA0)]
    ids, offsets = b.encode_chunks(chunks)
    for k, c in enumerate(chunks):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == b.library.encode(c, add_special_tokens=False).ids, hex(ord(c[1]))


@pytest.mark.parametrize("bits", [False, True])
def test_op4_round_trip(spark, docs, rows, tmp_path, bits):
    t = library()
    path = str(tmp_path / f"files{bits}")
    token_files.write_token_files(docs, path, TOKENIZER, block_ids=64, chunk_ids=500, bits=bits)
    got = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    crc = {r.doc_id: r.ids_crc32 for r in token_files.read_token_files(spark, path, digests=True).collect()}
    start = 0
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (list(got[i].ids), got[i].start, got[i].n_tokens) == (ids, start, len(ids))
        assert crc[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert sum(r.n_docs for r in index) == len(rows) and index[0].start == 0 and index[-1].start + index[-1].n_ids == start


def test_op4_empty_and_odd_tables(spark, docs, rows, tmp_path):
    token_files.write_token_files(empty(spark), str(tmp_path / "e"), TOKENIZER)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0
    token_files.write_token_files(odd_rows(spark, docs), str(tmp_path / "o"), TOKENIZER)
    got = token_files.read_token_files(spark, str(tmp_path / "o"))
    assert got.count() == len(rows) + 3 and got.where("doc_id IS NULL").first().start == 0


@pytest.mark.parametrize("kind", ["int", "string", "date"])
def test_op4_ids_of_any_type(spark, tmp_path, kind):
    df = spark.range(300).select((F.col("id").cast("int") if kind == "int" else F.col("id").cast("string") if kind == "string" else F.date_add(F.lit("2020-01-01"), F.col("id").cast("int"))).alias("key"), F.concat(F.lit("text "), "id").alias("text"))
    df = df.unionByName(df.select(F.lit(None).alias("key"), "text"))
    token_files.write_token_files(df.repartition(5), str(tmp_path / kind), TOKENIZER, id_col="key", chunk_ids=50)
    got = token_files.read_token_files(spark, str(tmp_path / kind), id_col="key")
    assert got.schema["key"].dataType == df.schema["key"].dataType and got.count() == 600
    rows = sorted(got.collect(), key=lambda r: r.start)
    keys = [r.key for r in rows]
    assert keys[:300] == [None] * 300 and keys[300:] == sorted(keys[300:]) and all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))


def test_op4_refuses_tokenizers_that_keep_white_space():
    with pytest.raises(ValueError):
        token_files.LibraryRuns(public_tokenizers.path("byte_bpe_50k.json"))


class Counted:
    """A tokenizer that notes the words it is handed."""

    def __init__(self, t):
        self.t, self.words = t, []

    def encode_batch_fast(self, texts, **options):
        self.words += [w for text in texts for w in re.split(r" |<\|endoftext\|>", text)]
        return self.t.encode_batch_fast(texts, **options)


def test_op4_hands_each_piece_to_the_library_once():
    runs = pa.array(["Tree", "tree,", "TREE.", "tree", "Tree's", "été", "ÉTÉ,", "日本"], pa.large_string())
    encoder = token_files.LibraryRuns(TOKENIZER)
    t, encoder.t = encoder.t, Counted(encoder.t)
    for _ in range(2):
        ids, offsets = encoder.encode(runs)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [t.encode(r, add_special_tokens=False).ids for r in runs.to_pylist()]
    assert Counter(encoder.t.words) == Counter(["tree", ",", "été", "日本"])  # "." and "'s" were in the probe


def test_op4_runs_of_every_kind_of_character(monkeypatch):
    encoder = token_files.LibraryRuns(TOKENIZER)
    monkeypatch.setattr(token_files, "CACHED", 3_000)
    runs = [f"{a}{chr(c)}{b}" for a, b in (("", ""), ("a", "B"), ("X'", "s"), (".", "1"), ("é", "É")) for c in range(0x21, 0x700)]
    runs = [r for r in runs if WORD.fullmatch(r)] + ["<|endoftext|>", "a<|startoftext|>b<|", "<|endoftext|>c", "</w>", "a</w>b", "x'll''d", "İ"]
    for k in (0, 1, 700, 1400, len(runs), 5):
        ids, offsets = encoder.encode(pa.array(runs[-k:] if k else [], pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [encoder.t.encode(r, add_special_tokens=False).ids for r in (runs[-k:] if k else [])]
    # What the library splits further is still parted rightly.
    ids, offsets = encoder._pieces(pa.array(["a,b", "c"], pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [encoder.t.encode(r, add_special_tokens=False).ids for r in ("a,b", "c")]


def brute_repeats(rows, split, width):
    """(id, units, removed mask) by comparing every window with all that start earlier."""
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        units = split(text or "")
        gone = [False] * len(units)
        for k in range(len(units) - width + 1):
            w = tuple(units[k : k + width])
            if w in seen:
                gone[k : k + width] = [True] * width
            seen.add(w)
        out[i] = (units, gone)
    return out


def test_op10_against_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr("framequery.llm.repeats.SHARD_BYTES", 20_000)
    want = brute_repeats(rows, WORD.findall, 20)
    got = {r.doc_id: r for r in passages.remove_passages(docs, carry=("n_words", "fp")).collect()}
    for i, (words, gone) in want.items():
        assert (got[i].n_words, got[i].n_removed, got[i].fp) == (len(words), sum(gone), "clash"), i
        assert got[i].kept == " ".join(w for w, g in zip(words, gone) if not g)
    assert sum(r.n_removed for r in got.values()) > 500
    assert passages.remove_passages(empty(spark)).count() == 0
    odd = passages.remove_passages(odd_rows(spark, docs), digests=True)
    assert odd.count() == len(rows) + 3 and odd.where("doc_id IS NULL").first().n_words == 3


def test_op10_rows_of_one_id(spark):
    text = " ".join(f"w{k}" for k in range(30))
    got = passages.remove_passages(spark.createDataFrame([(1, text), (1, text), (2, text + " z")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 30), (2, 30)]


def test_op2_against_brute_force(spark, docs, rows, monkeypatch):
    monkeypatch.setattr("framequery.llm.repeats.SHARD_BYTES", 30_000)
    want = brute_repeats(rows, lambda t: list(t.encode()), 100)
    got = {r.doc_id: r for r in byte_repeats.remove_repeated_bytes(docs).collect()}
    for i, (data, gone) in want.items():
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(data), sum(gone), runs), i
        assert bytes(got[i].kept) == bytes(b for b, g in zip(data, gone) if not g)
    assert byte_repeats.remove_repeated_bytes(empty(spark)).count() == 0
    assert byte_repeats.remove_repeated_bytes(odd_rows(spark, docs), digests=True).count() == len(rows) + 3


@pytest.mark.parametrize("hot", [1, 20_000])
def test_op2_and_op10_with_hot_triggers_and_text_ids(spark, rows, monkeypatch, hot):
    """The same windows go whether a trigger's phrases meet in one group or are dealt over slices; ids may be texts."""
    monkeypatch.setattr("framequery.llm.repeats.SHARD_BYTES", 10_000)
    monkeypatch.setattr("framequery.llm.repeats.HOT_PHRASES", hot)
    rnd = random.Random(8)
    core = " ".join(f"core{k}" for k in range(22))
    texts = [f"{' '.join(str(rnd.random()) for _ in range(rnd.randint(0, 12)))} {core} {rnd.random()} {rnd.random()}" for _ in range(40)]
    table = [(f"id{i:05d}", t) for i, t, *_ in rows] + [(f"x{k:03d}", t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(table, "name string, text string").repartition(3)
    want = brute_repeats(table, WORD.findall, 20)
    got = {r.name: r for r in passages.remove_passages(df, id_col="name").collect()}
    assert {i: (len(w), sum(g)) for i, (w, g) in want.items()} == {i: (r.n_words, r.n_removed) for i, r in got.items()}
    assert all(got[i].kept == " ".join(w for w, g in zip(words, gone) if not g) for i, (words, gone) in want.items())
    want = brute_repeats(table, lambda t: list(t.encode()), 100)
    got = {r.name: r for r in byte_repeats.remove_repeated_bytes(df, id_col="name").collect()}
    assert {i: bytes(b for b, g in zip(data, gone) if not g) for i, (data, gone) in want.items()} == {i: bytes(r.kept) for i, r in got.items()}


def test_equal_suffixes_against_all_pairs():
    rnd = random.Random(1)
    for stored, width in ((1, 10), (8, 3)):
        data = np.array([rnd.randint(0, 1) for _ in range(400 * stored)], np.uint8)
        starts = np.arange(300) * stored
        group = np.arange(300) // 150
        which, cls = repeats.equal_suffixes(data, starts, group, width, stored)
        names = [(g, data[a : a + width * stored].tobytes()) for a, g in zip(starts, group)]
        common = Counter(names)
        assert sorted(which) == [k for k in range(300) if common[names[k]] > 1]
        assert [names[k] for k in which] == sorted(names[k] for k in which)
        assert all((names[a] == names[b]) == (x == y) for a, b, x, y in zip(which, which[1:], cls, cls[1:]))


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op5_against_brute_force(spark, docs, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t, *_ in rows}
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and least[j] < least[i]:
                    least[i], changed = least[j], True
    for i in prints:
        assert (got[i].fp & (1 << 64) - 1, got[i].component_id) == (prints[i], least[i])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.near_duplicates(odd_rows(spark, docs)).count() == len(rows) + 3


@pytest.mark.parametrize("hot_rows", [50_000, 40])
def test_op5_links_lose_nothing(spark, hot_rows):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = list({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(8)})
    signed = [(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)]
    edges = simhash.links(spark.createDataFrame(signed, "node long, fp long").repartition(4), 3, hot_rows)
    found = {r.node: r.component for r in components.connected_components(edges).collect()}
    root = list(range(len(prints)))
    for _ in range(len(prints)):
        before = list(root)
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    assert [found.get(k, k) for k in range(len(prints))] == root


def test_op5_groups_are_taken_in_bounded_pieces(spark, monkeypatch):
    """Anchors by the piece, long texts by the piece: the results are those of one piece."""
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(20)]
    prints = list({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 3))) for b in base for _ in range(6)})
    df = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in enumerate(prints)], "node long, fp long").repartition(3)
    want = {r.node: r.component for r in components.connected_components(simhash.links(df)).collect()}
    monkeypatch.setattr(simhash, "ROWS_AT_ONCE", 5)
    assert {r.node: r.component for r in components.connected_components(simhash.links(df)).collect()} == want
    flat, offsets = words.split_words(pa.array(["a b c d e f g", "x", "", "p q r s"]))
    whole = simhash.hash_shingles(flat, offsets, 3)
    monkeypatch.setattr(simhash, "HASHED_AT_ONCE", 2)
    parts = simhash.hash_shingles(flat, offsets, 3)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and whole[1].tolist() == [0, 5, 6, 6, 8]


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components.connected_components(edges).collect()} == {0}
    assert components.connected_components(components.empty_edges(spark)).count() == 0


def test_op6_against_brute_force(spark, docs, rows):
    got = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    for i, text, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {p for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for p in range(k, k + 3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.kept and r.base_failed)
    assert quality.quality_verdicts(empty(spark)).count() == 0


def test_op6_order_never_changes_the_verdict(spark, docs):
    rules = quality.default_rules()
    a = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, rules).collect()}
    b = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, rules[::-1], sample_rows=5).collect()}
    assert a == b


def test_op6_cascade_takes_cheap_rules_that_reject_first(spark):
    text = " ".join(f"word{k}" for k in range(60))
    docs = quality.measures(spark.createDataFrame([(None, text + "!" * (k % 2)) for k in range(100)], "doc_id long, text string").unionByName(spark.createDataFrame([(7, text)] * 3, "doc_id long, text string")))
    dear = F.length("text") < 0
    for k in range(6):
        dear = dear | F.regexp_replace("text", f"w[o{k % 10}]+rd", "x").contains(f"zz{k}")
    rules = [quality.Rule("dear", dear), quality.Rule("never", F.col("n_words") < 0), quality.Rule("marks", F.col("text").endswith("!"))]
    (none, high), (zero, low), (half, cheap) = quality.rule_costs(docs.persist(), rules, repeats=40, runs=2)
    assert (none, zero, half) == (0, 0, 50) and high > low and high > cheap
    assert [r.name for r in quality.cascade_order(docs, rules)] == ["marks", "never", "dear"]
    _, by = quality.cascade([rules[2], rules[0]])
    assert docs.where(by == "marks").count() == 50


def test_op6_few_rows_are_judged_until_rules_outweigh_jobs(spark, monkeypatch):
    text = " ".join(f"word{k}" for k in range(60))
    docs = quality.measures(spark.createDataFrame([(k, text) for k in range(5)], "doc_id long, text string").repartition(2))
    dear = F.length("text") < 0
    for k in range(6):
        dear = dear | F.regexp_replace("text", f"w[o{k % 10}]+rd", "x").contains(f"zz{k}")
    asked, costs = [], quality.rule_costs
    monkeypatch.setattr(quality, "rule_costs", lambda *a: asked.append(a[2] if len(a) > 2 else 10) or costs(*a))
    rules = [quality.Rule("dear", dear), quality.Rule("never", F.col("n_words") < 0)]
    assert [r.name for r in quality.cascade_order(docs, rules)] == ["never", "dear"] and asked[0] > 10


def test_op3_against_all_pairs(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 40)))) for k in range(30)] + [(90, None), (91, ""), (92, "single")]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    for k in range(0, 60, 4):
        words = texts[k].split()
        at = rnd.randint(0, len(words))
        texts[k] = " ".join(words[:at] + items[k % 30][1].upper().split() + words[at:])
    docs = spark.createDataFrame([*enumerate(texts), (100, None), (101, "")], "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, table).collect()}
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if x and f" {x.lower()} " in f" {t.lower()} "}
    assert want <= got and len(want) >= 15
    for d, i in got:
        q = dict(items)[i].lower().split()
        q = q[: len(q) - max(1, len(q) // 4)] if len(q) > 1 else q
        n = decontaminate.shingles(texts[d].lower().split())
        assert len(decontaminate.shingles(q) & n) >= 0.8 * len(decontaminate.shingles(q)) or len(q) < 5
    whole, split = (sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.contaminated(docs, table, shard_bytes=b).collect()) for b in (32 << 20, 900))
    assert whole == split and table.agg(F.sum(F.octet_length("text"))).first()[0] > 3 * 900
    twice = decontaminate.contaminated(docs.unionByName(docs), table.unionByName(table))
    assert twice.count() == 4 * len(got)
    odd = docs.unionByName(spark.createDataFrame([(None, " ".join(["far"] * 3000) + " " + items[20][1])], docs.schema))
    assert decontaminate.contaminated(odd, table).where("doc_id IS NULL AND item_id = 20").count() == 1
    assert decontaminate.contaminated(docs, table.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), table).count() == 0


def test_op3_marks_and_an_altered_end_lose_no_passage(spark):
    words = [f"part{k}" for k in range(22)] + ["ключ", "chbeheitä"]
    near = [f"near{k}" for k in range(19)] + ["is", "42"]
    table = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(f"far{k}" for k in range(40)))], "item_id long, text string")
    marked = ["((" + words[0], *words[1:-1], words[-1] + ".%%%"]
    texts = [
        " ".join(marked),
        " ".join(["before", *marked[:9], "«" + words[9] + "»,", *marked[10:], "after"]),
        " ".join([*words[:-1], "altered", "end"]),
        " ".join(words[:12]) + " other words follow that belong to another text",
        " ".join(near[:-1] + ["43."]),
        " ".join([*near[:9], "x", "y", *near[11:]]),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contaminated(docs, table).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 1), (1, 1), (2, 1), (4, 2)]
    assert {r.doc_id: (r.question_overlap, r.answer_overlap) for r in got}[0] == (1.0, 1.0)


@pytest.mark.parametrize("dense", [0, 4_000_000])
def test_op3_wand_finds_all_above_the_threshold(monkeypatch, dense):
    monkeypatch.setattr(decontaminate, "DENSE_SUMS", dense)
    monkeypatch.setattr(decontaminate, "POSTINGS_AT_ONCE", 500)
    rnd = random.Random(4)
    vocabulary = [f"t{k}" for k in range(60)]
    items = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 16))] for _ in range(50)]
    index = decontaminate.build_index(pa.array(range(50)), pa.array(" ".join(x) for x in items))
    place = {t: k for k, t in enumerate(index.terms.to_pylist())}
    sets = [sorted(rnd.sample(range(len(place)), rnd.randint(1, 30))) for _ in range(200)]
    p, i, s = decontaminate.query_passages(index, np.array([t for x in sets for t in x]), np.array([k for k, x in enumerate(sets) for _ in x]), len(sets))
    df, mean = Counter(t for x in items for t in set(x)), np.mean([len(x) for x in items])
    impacts = [{place[t]: math.log1p((50 - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t, c in Counter(x).items()} for x in items]
    want = {(k, n): sum(w.get(t, 0) for t in x) / sum(w.values()) for k, x in enumerate(sets) for n, w in enumerate(impacts)}
    want = {k: v for k, v in want.items() if v >= index.threshold - 1e-9}
    got = {(int(a), index.ids[int(b)].as_py()): v for a, b, v in zip(p, i, s)}
    assert len(want) > 20 and set(got) == set(want) and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_op8_on_held_out_labels(spark):
    rnd = random.Random(6)
    bad = ["vile", "rotten", "grubby"]

    def text(k):
        words = [rnd.choice("sun tree river stone house cloud bird road".split()) for _ in range(60)]
        if k % 5 == 0:
            for _ in range(4):
                words[rnd.randrange(60)] = rnd.choice(bad)
        if k % 7 == 1:
            words = [w.upper() + "!!" for w in words]
        return " ".join(words)

    rows = [(k, text(k), "clash") for k in range(400)] + [(900, None, ""), (901, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic string")
    labels = spark.createDataFrame([(k, int(k % 7 != 1), int(k % 5 == 0)) for k in range(0, 400, 2)] + [(2, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxic_verdicts(docs, labels).collect()}
    unseen = range(1, 400, 2)
    assert np.mean([got[k].toxic == (k % 5 == 0) for k in unseen]) > 0.95
    assert not got[900].toxic and not got[901].toxic
    none = toxicity.toxic_verdicts(docs, labels.limit(0)).collect()
    assert len(none) == 402 and not any(r.toxic for r in none)
    assert toxicity.toxic_verdicts(docs.limit(0), labels).count() == 0


def test_op8_bounds_rows_and_keeps_copies_in_one_fold(spark):
    rows = [(1, f"word{k} vile text") for k in range(50)] + [(1, "word0 vile text")] * 50 + [(None, "no id"), (2, "other text"), (2, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    held = []
    fit = toxicity._fit

    def spy(r, c, n, width, dense, y, use, l2, rounds):
        held.append((n, use))
        return fit(r, c, n, width, dense, y, use, l2, rounds)

    toxicity._fit = spy
    try:
        toxicity.train_chain(docs, labels, toxicity.label_categories(), max_labelled=7)
        assert {n for n, _ in held} == {7}
        held.clear()
        toxicity.train_chain(docs, labels, toxicity.label_categories())
        assert {n for n, _ in held} == {51}
    finally:
        toxicity._fit = fit
    got = toxicity.toxic_verdicts(docs, labels).collect()
    assert len(got) == len(rows) and len({(r.text, r.p_toxic) for r in got}) == len({t for _, t in rows})


def test_op1_base_and_probabilities(spark, docs, rows):
    got = {r.doc_id: r for r in hmm.score_texts(docs, own=20, endings=8, frequent=40, states=3, rounds=3).collect()}
    words = {i: WORD.findall((t or "").translate(LOWER)) for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i in words if not held[i] for w in words[i])
    ends = sum(not h for h in held.values())
    n, v = counts.total() + ends, len(counts) + 1
    for i, w in words.items():
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert hmm.score_texts(empty(spark)).count() == 0
    assert hmm.score_texts(odd_rows(spark, docs).withColumn("doc_id", F.col("doc_id").cast("int")), rounds=1).count() == len(rows) + 3


def test_op1_forward_equals_the_sum_over_paths():
    rng = np.random.default_rng(2)
    model = hmm.Model(*(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((5, 3)), 0))))
    seqs = [rng.integers(0, 5, k) for k in (1, 4, 2, 6)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    got = hmm.log_likelihoods(model, np.concatenate(seqs), offsets)
    for s, g in zip(seqs, got):
        paths = np.stack(np.meshgrid(*[range(3)] * len(s), indexing="ij"), -1).reshape(-1, len(s))
        p = sum(model.start[z[0]] * model.emit[s[0], z[0]] * math.prod(model.move[z[t - 1], z[t]] * model.emit[s[t], z[t]] for t in range(1, len(s))) for z in paths)
        assert abs(g - math.log10(p)) < 1e-9
    starts, moves, emits, total = hmm.expected_counts(model, np.concatenate(seqs), offsets)
    assert abs(total / math.log(10) - got.sum()) < 1e-9
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))]
    for s, g in zip(seqs, got):
        for z in np.stack(np.meshgrid(*[range(3)] * len(s), indexing="ij"), -1).reshape(-1, len(s)):
            p = model.start[z[0]] * model.emit[s[0], z[0]] * math.prod(model.move[z[t - 1], z[t]] * model.emit[s[t], z[t]] for t in range(1, len(s))) / 10**g
            want[0][z[0]] += p
            for t in range(len(s)):
                want[2][s[t], z[t]] += p
                if t:
                    want[1][z[t - 1], z[t]] += p
    assert all(np.allclose(a, b) for a, b in zip((starts, moves, emits), want))


@pytest.mark.parametrize("piece", [1, 3, 7, 100])
def test_op1_long_texts_by_pieces(piece):
    rng = np.random.default_rng(3)
    model = hmm.Model(*(x / x.sum(axis=a, keepdims=True) for x, a in ((rng.random(3), 0), (rng.random((3, 3)), 1), (rng.random((5, 3)), 0))))
    seq = rng.integers(0, 5, 21)
    whole, parts = hmm.expected_counts(model, seq, np.array([0, 21])), hmm.long_counts(model, seq, piece)
    assert all(np.allclose(a, b) for a, b in zip(whole, parts))


def test_op1_learns(spark, monkeypatch):
    """Likelihood rises by the rounds, also where every text is longer than what is run at once; the model of runs of
    like words beats the single words' counts on texts it has not seen."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(("red", "blue", "green") if k // 8 % 2 else ("cat", "dog", "owl")) for k in range(rnd.randint(20, 60))) for _ in range(120)]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "name string, text string").repartition(3)
    got = hmm.score_texts(docs, own=10, endings=4, frequent=20, states=3, rounds=12, id_col="name").collect()
    unseen = [r for r in got if r.held_out]
    assert len(got) == 120 and unseen and all(r.score > r.base_score + 0.1 * r.n_tokens for r in unseen)
    lexicon = hmm.Lexicon(pa.array(["a", "b"], pa.large_string()), np.array([5, 3]), 2, np.zeros(1, np.int64), np.zeros(1, np.int64), 3, 11, 3)
    rows = [(np.array([0, 1] * 15 + [3], "<u2").tobytes(),), (np.array([1, 0, 0, 1, 3], "<u2").tobytes(),)]
    codes = spark.createDataFrame([(bytearray(b),) for (b,) in rows], "codes binary")
    model, history = hmm.train(codes, lexicon, 2, 8, 1)
    assert all(b > a - 0.05 for a, b in zip(history, history[1:])) and history[-1] > history[0] + 5
    monkeypatch.setattr(hmm, "TOKENS_AT_ONCE", 4)
    again, _ = hmm.train(codes, lexicon, 2, 1, 1)
    monkeypatch.undo()
    assert np.allclose(again.move, hmm.train(codes, lexicon, 2, 1, 1)[0].move, atol=1e-5)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a>x</a></ul></nav>
<div class="sidebar-2">Side text that is long enough to matter for anyone who reads it.</div><div class="post-17 content"><h1>Title &amp; more</h1><p>First   line<br>goes on.<p>Second &lt;b&gt; <i>one</i>.
<div class="ad">Buy now</div><form><p>Your mail</p></form><ul><li>Point<li>Other</ul></div><div id="comments"><p>Reader says a lot of things here, longer than the text.</p></div><footer>End</footer></body></html>"""


def test_op9_known_page(spark):
    rows = [(1, "https://A.example.com:8080/x?y", PAGE), (2, "http://a.example.com/2", None), (3, None, ""), (4, "http://a.example.com/4", PAGE.replace("post-17", "post-99")), (5, "nonsense", "just text")]
    got = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Title & more\n\nFirst line goes on.\n\nSecond <b> one.\n\nPoint\n\nOther"
    assert got == {1: want, 2: "", 3: "", 4: want, 5: "just text"}
    assert pages.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_op9_hostile_pages_take_linear_time():
    began = time.perf_counter()
    for piece in ("<div>", "<div>text", "<a ", "<b>", "<p class='x", '<a href="', "<!", "<!-", "<ul><li>", "</div>", "<span>x</p>", "<table><tr><td>", "<"):
        page = pages.parse(piece * (1_000_000 // len(piece)))
        pages.main_text(page, pages.best_container(page)[0] if pages.best_container(page) else None)
    assert time.perf_counter() - began < 120
    began = time.perf_counter()
    pages.main_text(pages.parse("<div>" * 200_000 + "text"), None)
    assert time.perf_counter() - began < 5


def test_op9_prose_stays_whatever_its_class_is_called(spark):
    prose = "A paragraph about how neighbours share their tools and look after one another."
    page = f"<body><article><p class=social>{prose}</p><p class=share>Share</p><p class=ad>{prose} Buy!</p><div class=share>{prose}</div><p>End of it.</p></article></body>"
    assert pages.main_text(pages.parse(page), None) == f"{prose}\n\nEnd of it."
    assert pages.main_text(pages.parse("<p>a \"quote <b class='never ends>b</b> c</p><p>d</p>"), None) == "a \"quote b c\n\nd"


def test_op9_the_vote_of_a_host_overrides_a_page(spark):
    """Only links stand beside the story on most pages of a host; where a page has other words there, by itself they seem
    to belong to the story, but the host's path tells."""
    story = ("The story goes on and on. " * 20).strip()
    shell = "<body><div class=story-{}><p>{}</p></div><div class=extra>{}</div></body>"
    links, more = "<a href=/a>Another page of the host</a> " * 3, "<p>Some words that are no links.</p>"
    rows = [(k, "http://h.org/x", shell.format(k, story, links)) for k in range(5)] + [(9, "http://h.org/y", shell.format(9, story, more)), (10, "http://other.org/y", shell.format(9, story, more))]
    df = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")
    got = pages.extract_main_text(df).collect()
    assert len(got) == 8 and {r.page_id: r.text for r in got} == {**{k: story for k in (0, 1, 2, 3, 4, 9)}, 10: f"{story}\n\nSome words that are no links."}
    assert {r.host: r.path for r in pages.host_paths(df).collect()} == {"h.org": "body div.story-#", "other.org": "body"}
    assert pages.extract_main_text(df, broadcast_bytes=0).count() == 8


def test_op9_hosts(spark):
    urls = ["HTTP://User@Www.A.org:80/x", "https://b.net?x", "//c", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(pages.host_of(F.col("url")).alias("h"))
    assert [r.h for r in df.collect()] == ["www.a.org", "b.net", "", ""]


def test_op9_keeps_whole_articles(spark):
    long, short = "Long text of the article goes on. " * 40, "Short part. " * 4
    shell = "<html><body><nav><a href=/>Home</a></nav>{}<footer>Foot</footer></body></html>"
    nested = "<article><h1>Head</h1><p>Lead paragraph.</p><div class=body><p>{}</p></div></article>".format(long)
    split = "<div class=wrap><section class=one><p>{}</p></section><section class=two><p>{}</p></section></div>".format(long, short)
    linked = "<div class=wrap><div class=text><p>{}</p></div><div class=more><a href=/1>Some other page</a> <a href=/2>And another</a></div></div>".format(long)
    # Most pages of the host have one template; one has only a teaser at that template's path.
    usual = "<div class=story><p>{}</p></div>".format(long)
    other = "<div class=top><div class=story><p>Teaser.</p></div></div><section class=full><p>{}</p></section>".format(long)
    odd = "<div class=story><p>Teaser.</p></div><section class=full><p>{}</p></section>".format(long)
    around = "<article><p>Lead paragraph.</p><div class=story><p>{}</p></div></article>".format(long)
    pages_of = [("a", nested), ("b", split), ("c", linked), ("d", usual), ("d", usual), ("d", usual), ("d", odd), ("d", other), ("d", around)]
    rows = [(k, f"http://{host}.org/{k}", shell.format(html)) for k, (host, html) in enumerate(pages_of)]
    got = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    long, short = long.strip(), short.strip()
    assert got[0] == f"Head\n\nLead paragraph.\n\n{long}"
    assert got[1] == f"{long}\n\n{short}"
    assert got[2] == long
    assert got[3] == got[4] == got[5] == long
    assert got[6] == got[7] == f"Teaser.\n\n{long}"
    assert got[8] == f"Lead paragraph.\n\n{long}"
