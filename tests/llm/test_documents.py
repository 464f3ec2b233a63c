"""Operators on documents: brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from corpuskit.llm import bpe, common, langid, licenses, linededup, mixing, simhash, sstable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, block int, fp string, line string, n int"


def rows(seed=1):
    rng = random.Random(seed)
    words = {"en": "the of and to in is that it was for".split(), "fr": "le la les des une est pour dans que qui".split()}
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        text = "\n".join(" ".join(rng.choices(words[lang], k=rng.randint(1, 30))) for _ in range(rng.randint(1, 4)))
        out.append((i, text, lang, f"s{i % 5}" if i % 11 else None))
    out += [(100, None, "en", "s1"), (101, "", None, "s2"), (102, " \n\t ", "en", "s1"), (103, "12 34 !!", None, "s0"), (104, "x", "fr", "s0")]
    out += [(105, " ".join(rng.choices(words["en"], k=40_000)), "en", "s0")]
    out += [(5, out[5][1], "en", out[5][3])] * 2  # repeated rows
    out += [(110 + i, out[7][1], "en", f"s{i % 5}") for i in range(12)]  # copies
    out += [(130, out[7][1] + " and", "en", "s1"), (None, "the of and", "en", "s3"), (131, "a\x1cb 日本 𠮷 é", "fr", "𠮷"), (-7, "neg the of", "en", "")]
    return [(i, t, g, s, len(t or ""), "k", 1, "f", "l", 2) for i, t, g, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_targets_share_and_stop():
    assert mixing.targets([]) == []
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])  # 225 is above 200; 25 goes 1 : 2
    sizes = [5, 1000, 0, 300, 70]
    got = mixing.targets(sizes)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))


def test_splitting_tree_is_exact():
    got = mixing.split_quotas([100, 7, 0, 5000], 13, 3)
    assert got.sum(axis=0).tolist() == [100, 7, 0, 5000] and (got >= 0).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 4
    assert (got == mixing.split_quotas([100, 7, 0, 5000], 13, 3)).all()


def test_mix(spark, docs, empty):
    got = mixing.plan(docs, shards=8).collect()
    again = mixing.plan(docs.repartition(2), shards=8).collect()
    key = lambda r: (str(r.doc_id), r.text_key, r.taken, str(sorted(r.copies)))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == docs.count()
    sizes, source = defaultdict(int), {}
    for i, text, _, s, *_ in rows():
        sizes[s] += len(words(text))
        source[i] = s
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([sizes[s] for s in names])))
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r["size"] and r.taken == sum(c.words for c in r.copies)
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    mixed = mixing.mix(docs, shards=8)
    assert mixed.columns == docs.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    pieces = mixing.mix(docs, shards=8, piece_words=20)
    assert pieces.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(str, pieces.collect())) == sorted(map(str, mixed.collect()))
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


@pytest.mark.parametrize(("blocks", "whole"), [(200_000, False), (0, False), (200_000, True)])
def test_mix_of_repeated_rows(spark, monkeypatch, blocks, whole):
    """Words mixed are words planned where rows repeat, in the block that is taken in part too."""
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", blocks)
    for n in (1, 4, 7):
        data = [(1, "one two three four five", "a", "x", 0, i) for i in range(50)] + [(2, "six seven", "a", "y", 0, i) for i in range(3)] + [(3, "eight nine ten", "b", None, 0, 0)] * n
        data += [(2, "six seven", "a", "z", 0, 1), (None, "null id here", "a", "x", 0, 1), (None, "null id here", "a", "x", 0, 1), (5, None, "a", "x", 0, 1)]
        table = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, block int").repartition(3)
        planned = mixing.plan(table, shards=1).collect()
        want = sum(r.taken for r in planned)
        if whole:
            want = sum(r["size"] for r in planned for c in r.copies if 2 * c.words >= r["size"])
        got = mixing.mix(table, shards=1, whole=whole)
        assert got.columns == table.columns
        assert sum(len(words(r.text)) for r in got.collect()) == want


def test_byte_bpe(docs, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(docs, path, P.PATTERN).collect())
    want = []
    for i, text, *_ in rows():
        ids = np.array(encoding.encode_ordinary(text or ""), "<u4")
        want.append((str(i), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(empty, path, P.PATTERN).count() == 0


def test_byte_bpe_pieces():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    coder = bpe.ByteBPE(ranks, P.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "th", "e", "ing", " ", "\n", "日本", "1", "'s", "é", "🙂", "zq"], k=rng.randint(0, 30)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == encoding.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()
    assert coder.encode_piece(b"ab" * 50_000) == encoding.encode_ordinary("ab" * 50_000)
    assert coder.decode(np.array(coder.encode_piece(bytes(range(256))), "<u4").tobytes()) == bytes(range(256))


def test_simhash(docs, empty):
    data = rows()
    prints = {(i, t): simhash.fingerprint(t) for i, t, *_ in data}
    assert prints[100, None] == prints[101, ""] == prints[102, " \n\t "] == 0
    label = {k: k for k in prints}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = list(prints)
    for a in keys:
        for b in keys:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                label[top(a)] = top(b)
    least = {}
    for k in keys:
        if k[0] is not None:
            least[top(k)] = min(least.get(top(k), k[0]), k[0])
    want = sorted((str(i), prints[i, t], least.get(top((i, t)))) for i, t, *_ in data)
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_simhash_keeps_one_row_of_each_component(spark):
    one, two = "the cat sat on the mat", "a quite different line of words"
    docs = spark.createDataFrame([(1, one), (1, two), (2, one), (1, one), (None, two), (None, "no id at all here")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect())
    assert got == [("1", two), ("1", one)]


def test_pipeline_keeps_a_row_of_groups_without_an_id(spark):
    one, two, three = "the cat sat on the mat", "a quite different line of words", "no id at all here"
    docs = spark.createDataFrame([(1, one), (None, one), (None, two), (None, two), (None, three), (2, None), (None, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted([("1", one), ("None", two), ("None", three), ("2", "None")])


@pytest.mark.parametrize(("wide", "home", "chunk"), [(10**7, 128, 2048), (0, 128, 2048), (10**7, 2, 3), (0, 3, 2048)])
def test_simhash_links_against_all_pairs(spark, monkeypatch, wide, home, chunk):
    """All pairs where cells are small; in hot cells, and in all, the same components."""
    for name, value in (("WIDE_MAX", wide), ("HOME", home), ("HOME_CHUNK", chunk)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1, 2**63}
    for x in list(prints):
        for _ in range(4):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {(r.a, r.b) for r in found.collect()}
    assert len(want) > 300 and (home < 100 or got == want)
    label = {x: x for x in signed}
    for _ in range(20):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in common.components(found).collect()} == {x: y for x, y in label.items() if any(x in p for p in want)}


def test_simhash_of_a_hot_cell():
    """A forest has the components of all pairs and fewer edges than rows."""
    rng = random.Random(2)
    every = np.unique(np.array([rng.choice([0, 7 << 40]) ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(400)] + [-1, -8], dtype=np.int64))
    a, b = simhash._forest(every, every, 3)
    assert len(a) < len(every)
    label = {int(x): int(x) for x in every}
    for _ in range(400):
        before = dict(label)
        for x, y in zip(a.tolist(), b.tolist()):
            label[x] = label[y] = min(label[x], label[y])
        if before == label:
            break
    plain = {int(x): int(x) for x in every}
    for _ in range(10):
        for x in plain:
            plain[x] = min(plain[y] for y in plain if bin((x ^ y) & (2**64 - 1)).count("1") <= 3)
    assert label == plain


def test_fingerprint_bit_by_bit():
    rng = random.Random(12)
    for text in ["", " \n", "One", "A b", "a b c", "\u00c9 b C d", "x y x y x y x"] + [" ".join(rng.choices(["aB", "c", "\u00e9", "d\u2003e", "f."], k=rng.randint(1, 60))) for _ in range(30)]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words_ = [w for w in re.split("[ \t\n\v\f\r]+", low) if w]
        grams = [" ".join(words_[i : i + 3]) for i in range(len(words_) - 2)] or ([" ".join(words_)] if words_ else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) == want


def test_token_shards(spark, docs, empty, tmp_path):
    path = P.path("word_bpe_49k.json")
    manifest = sstable.write_shards(docs, path, f"file://{tmp_path}", shards=3)
    got = sorted((r.start, str(r.doc_id), r.n_tokens, r.ids_crc32) for r in sstable.read_shards(docs, manifest).collect())
    tokenizer = Tokenizer.from_file(path)
    ids_of = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    want, at = [], 0
    for start, name, n, crc in got:
        assert start == at
        at += n
    for i, text, *_ in rows():
        ids = np.array(ids_of(text), "<u4")
        want.append((str(i), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(x[1:] for x in got) == sorted(want)
    order = [None if x[1] == "None" else int(x[1]) for x in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    shards = [sstable.open_shard(m["path"]) for m in manifest]
    for i, text, *_ in rows():
        found = [ids.tolist() for s in shards for ids in s.get(i)]
        assert ids_of(text) in found and len(found) == sum(r[0] == i for r in rows())
    assert not any(s.get(999) for s in shards) and sstable.lookup(manifest, 999) == []
    for i in {r[0] for r in rows()}:
        assert sorted(ids.tolist() for ids in sstable.lookup(manifest, i)) == sorted(ids_of(t) for j, t, *_ in rows() if j == i)
    assert sstable.encode_to_shards(empty, path).count() == 0


ODD = ["it's we're", "don't!'s", "e\u0301t\u00e9 E\u0301", "a\u0301.b\u0301!", "x<|endoftext|>y <|startoftext|>", "a\x1cb\x1d. \x1e", "a\xa0b\x85c\u2028d\u3000e", "日本語の文章。テスト", "A1b2 007 0 00", "Ça&&& ÉTÉ### naïve,%%%",
       "\u212bngstr\u00f6m \u01c5 \ufb01 ﬀ", "'" * 3 + " '", "…-- —x—", "𠮷𠮷 a𝒳b", "word. word, (word) word! Word WORD", "\u0130stanbul STRASSE ß", "a\u0327\u0301b a\u0301\u0327", "", " ", "\n\t\x0b\x0c\r", "x" * 300, "ªº µ"]


@pytest.mark.parametrize(("part", "words"), [(4 << 20, 300_000), (40, 50)])
def test_shard_coder_equals_the_library(monkeypatch, part, words):
    monkeypatch.setattr(sstable, "PART", part)
    monkeypatch.setattr(sstable, "WORDS", words)
    rng, path = random.Random(4), P.path("word_bpe_49k.json")
    tokenizer, coder = Tokenizer.from_file(path), sstable._Coder(open(path, encoding="utf-8").read())
    pieces = [w for t in ODD for w in t.split(" ")] + [c for t in ODD for c in t]
    texts = ODD + ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n", "\xa0", "'", "."]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None]
    want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u2").tobytes() for t in texts]
    for lot in (texts, texts[::-1]):
        assert list(coder.encode(pa.array(lot))) == (want if lot is texts else want[::-1])
    other = sstable._Coder(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert coder.splits and not other.splits
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert list(other.encode(pa.array(ODD[:5]))) == [np.array([*library.encode(t, add_special_tokens=False).ids, 1], f"<u{other.width}").tobytes() for t in ODD[:5]]


def test_token_shards_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARD_BYTES", 50_000)
    path, text = P.path("word_bpe_49k.json"), "The quick, brown fox: it's over 9 lazy dogs.\n" * 30_000
    table = spark.createDataFrame([(2, text, "a"), (1, None, "b"), (2, text, "c")], "doc_id long, text string, order string")
    manifest = sstable.write_shards(table, path)
    assert sum(m["docs"] for m in manifest) == 3 and [(m["first"], m["last"]) for m in manifest if m["docs"]][-1] == (2, 2)
    ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sstable.read_shards(table, manifest).collect())
    crc = zlib.crc32(np.array(ids, "<u4").tobytes())
    assert got == [(1, 0, 1, zlib.crc32(b"\1\0\0\0")), (2, 1, len(ids), crc), (2, 1 + len(ids), len(ids), crc)]


def test_shard_writer_format(tmp_path):
    with open(tmp_path / "x.sst", "wb") as f:
        writer = sstable.ShardWriter(f, 4)
        for i in range(5000):
            writer.add(i * 3 - 6000, np.arange(i % 70, dtype="<u4").tobytes())
        with pytest.raises(ValueError):
            writer.add(0, b"")
        writer.finish()
    shard = sstable.open_shard(f"file://{tmp_path}/x.sst")
    assert shard.docs == 5000 and len(shard.index) > 1
    assert [ids.tolist() for ids in shard.get(-6000 + 3 * 69)] == [list(range(69))]
    assert [k for k, _ in shard.scan()] == [i * 3 - 6000 for i in range(5000)]
    misses = sum(all(shard.bloom[p >> 3] >> (p & 7) & 1 for p in sstable._places(sstable.doc_key(i), shard.bits)) for i in range(10**6, 10**6 + 2000))
    assert misses < 60


def test_language_id(docs, empty):
    got = {r.doc_id: r for r in langid.detect(docs).collect()}
    for i in (100, 101, 102, 103):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    wrong = [i for i, t, g, *_ in rows() if i is not None and i < 60 and got[i].lang_pred != g]
    assert len(wrong) <= 2
    for r in got.values():
        assert 0 <= r.score <= 1
        assert r.held_out is (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert all(r.lang == got[r.doc_id].lang_pred for r in kept.collect())
    assert langid.detect(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_language_id_learns_from_its_fold_alone(spark, docs):
    before = langid.fit(docs)
    held = [r for r in rows() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    changed = [(r[0], "zzz " * 50, "xx", *r[3:]) if r in held else r for r in rows()]
    assert langid.fit(spark.createDataFrame(changed, SCHEMA)) == before


def gram_counts(text):
    """All 1- to 3-grams of the words of a text between marks, one by one; a pair may span two words' marks, a triple may not."""
    marked = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    marked = " " + "".join(w + " " for w in marked.split(" ") if w)
    code = lambda s: [1 if c == " " else ord(c) + 2 for c in s]
    out = defaultdict(int)
    for i in range(len(marked)):
        if marked[i] != " ":
            out[code(marked[i])[0]] += 1
        if i + 1 < len(marked):
            a, b = code(marked[i : i + 2])
            out[a << 21 | b] += 1
        if i + 2 < len(marked) and marked[i + 1] != " ":
            a, b, c = code(marked[i : i + 3])
            out[a << 42 | b << 21 | c] += 1
    return out


@pytest.mark.parametrize("span", [1_000_000, 7, 1])
def test_gram_counts_of_whole_texts(monkeypatch, span):
    monkeypatch.setattr(langid, "SPAN", span)
    rng = random.Random(3)
    for text in ["", "a", " a ", "ab  12 cd", "12", "ΑΣ ΟΔΟΣ, Σ", "𠮷日 x", "…"] + ["".join(rng.choices("abÇé  .9", k=rng.randint(0, 60))) for _ in range(60)]:
        keys, counts = langid._grams(text)
        assert dict(zip(keys.tolist(), counts.tolist())) == dict(gram_counts(text)) and sorted(keys) == list(keys)


def test_out_of_place_distance():
    """Predictions against ranks looked up one by one in lists."""
    assert langid.predict("", *langid._table({"a": [1, 2, 3], "b": [3, 2]})) == ("und", 0.0)
    texts = {"x": "the cat and the dog and the hen " * 9, "y": "le chat et le chien et la poule " * 9, "w": "ein Hund und eine Katze und der Hahn " * 9}
    ranked = lambda t: [k for k, _ in sorted(gram_counts(t).items(), key=lambda x: (-x[1], x[0]))][: langid.PROFILE]
    profiles = {lang: ranked(t) for lang, t in texts.items()}
    table, rng = langid._table(profiles), random.Random(5)
    every = [w for t in texts.values() for w in t.split()]
    for _ in range(60):
        text = " ".join(rng.choices(every, k=rng.randint(1, 30)))
        own = ranked(text)
        far = {x: sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        got = langid.predict(text, *table)
        assert got[0] == best and got[1] == pytest.approx(1 - far[best] / (langid.PROFILE * len(own)))


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.detect(docs).where("held_out").join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 200 and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def removed(data, least=10):
    """Brute force: ``(id, text left)`` of rows ``(id, text, site)``."""
    sites, texts = defaultdict(set), defaultdict(set)
    for _, text, site in data:
        for line in (text or "").split("\n"):
            sites[line.strip(" \t\n\v\f\r")].add(site or "")
            texts[line.strip(" \t\n\v\f\r")].add(text)
    out = []
    for i, text, _ in data:
        keys = [(x, x.strip(" \t\n\v\f\r")) for x in (text or "").split("\n")]
        rest = [(x, k) for x, k in keys if not k or len(sites[k]) < least or len(texts[k]) < least]
        out.append((str(i), text if text is None or not any(k for _, k in rest) else "\n".join(x for x, _ in rest)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_line_dedup(spark, docs, empty, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST", broadcast)
    monkeypatch.setattr(common, "HOT_ROWS", 500 if broadcast else 2)
    shared, rng = "this line stands on very many sites", random.Random(6)
    data = [(i, f"own words number {i} of this text\n {shared} \nmore own words {i * 7} here\n\nand still more words of {i}", f"site{i}") for i in range(14)]
    data += [(50, f"only {shared}\n{shared}", "site1"), (51, shared, "site2"), (51, f" {shared}\t\n\n", "site2"), (52, None, None), (53, "", None), (54, "rare\nrare", "site3"), (None, f"{shared}\nx", None)]
    data += [(60 + i, "on nine sites alone and here are more words", f"site{i}") for i in range(9)]
    data += [(80 + i, "a text copied to many sites\nwith two lines", f"site{i}") for i in range(14)]  # copies are no boilerplate
    data += [(100 + i, f"a near copy\nof many sites\nbut for {i}", f"site{i}") for i in range(14)]
    data += [(200 + k * 20 + j, f"line of {k} sites\nfiller one {k} {j} with words\nfiller two {k} {j} with words", f"site{j % k}") for k in range(6, 15) for j in range(k + 3)]
    data += [(500 + k * 20 + j, f"line of {k} texts\n{j % k}", f"site{j}") for k in range(6, 15) for j in range(16)]
    data += [(900 + i, "\n".join(rng.choices([f"often {k}" for k in range(12)] + [f"seldom {k}" for k in range(300)], k=6)), rng.choice([f"s{k}" for k in range(12)] + ["", None])) for i in range(150)]
    data += [data[0], data[0]]
    table = spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 1, "f", "l", 2) for i, t, s in data], SCHEMA).repartition(3)
    want = removed(data)
    got = linededup.report(table).collect()
    assert sorted(((str(r.doc_id), r.text) for r in got), key=str) == want
    own = {r.doc_id: r for r in got if r.doc_id != 51}
    assert (own[3].n_lines, own[3].n_shared, own[3].n_removed, own[3].all_shared) == (4, 1, 1, False)
    assert (own[52].n_lines, own[52].n_shared, own[54].n_lines, own[60].n_shared, own[85].n_shared, own[105].n_removed) == (0, 0, 2, 0, 0, 2)
    assert all((r.n_lines, r.n_shared, r.n_removed, r.all_shared) == (1, 1, 0, True) for r in got if r.doc_id == 51)
    left = linededup.remove_lines(table)
    assert left.columns == table.columns
    rows_left = left.collect()
    assert sorted(((str(r.doc_id), r.text) for r in rows_left), key=str) == want
    assert all(r.n_chars == len(r.text or "") for r in rows_left)
    assert linededup.report(empty).count() == 0 and linededup.remove_lines(empty).count() == 0
    assert linededup.remove_lines(docs).count() == docs.count()


def test_licenses(spark, docs, empty):
    data = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose."), (2, "LICENSED UNDER CC BY-NC 4.0."), (3, "She renewed her driving license last week."),
        (4, "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3."), (5, None), (6, ""),
        (7, "The copyright of the permission is a license " * 2000), (8, "Released under the MIT License."), (8, "Released under the MIT License."),
        (9, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ]
    table = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' AS family", "1 AS words", "2 AS gram")
    got = {r.doc_id: r for r in licenses.scan(table).collect()}
    assert {i: r.families for i, r in got.items()} == {1: ["MIT"], 2: ["CC-BY-NC"], 4: ["Apache-2.0", "GPL"], 8: ["MIT"], 9: ["MIT"]}
    assert got[4].n_paragraphs == 2 and all(r.least_probability >= 0.5 and r.least_coverage >= 0.6 for r in got.values())
    assert licenses.scan(empty).count() == 0
    assert licenses.scan(docs).count() == 0


def test_license_classifier_against_numpy(spark):
    families, grams, weights, bias = licenses.trained()
    index = {g: i for i, g in enumerate(grams)}
    held = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.EVERYDAY
    want = {}
    for text in held:
        z = bias + sum((weights[index[g]] for g in licenses.grams_of(licenses.words_of(text)) if g in index), np.zeros(len(families)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = families[int(np.argmax(z))]
        if best != licenses.UNKNOWN and p.max() >= 0.5:
            cover = max(len(licenses.pairs_of(t) & licenses.pairs_of(text)) / len(licenses.pairs_of(t)) for t in licenses.TEMPLATES[best])
            if cover >= licenses.COVERAGE:
                want[text.lower()] = (best, round(float(p.max()), 6), round(cover, 6))
    table = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(held)], "paragraph_key long, paragraph string")
    got = {held[r.paragraph_key].lower(): (r.family, round(r.probability, 6), round(r.coverage, 6)) for r in licenses.classify(table).collect()}
    assert got == want
    assert not any(t.lower() in got for t in licenses.EVERYDAY)
    templates = {t.lower(): f for f, ts in licenses.TEMPLATES.items() for t in ts}
    right = sum(got.get(t, ("",))[0] == f for t, f in templates.items())
    assert right >= 0.9 * len(templates)


def test_license_gates_lose_nothing():
    """Without the gate words no template can reach the coverage asked for."""
    for templates in licenses.TEMPLATES.values():
        for t in templates:
            low = t.lower()
            if not any(g in low for g in licenses.GATES):
                raise AssertionError(t)


def test_license_notices_need_a_gate_word(spark):
    """No text that reaches the coverage asked for lacks a gate word, and short notices are found."""
    for t in (t for ts in licenses.TEMPLATES.values() for t in ts):
        pairs = licenses.pairs_of(t)
        assert sum(not set(p.split()) & set(licenses.GATES) for p in pairs) < licenses.COVERAGE * len(pairs)
    data = [(1, "All rights reserved."), (2, "some prose\nAvailable under CC BY-SA 4.0.\nmore"), (3, "1.0Copyright. All rights reserved."), (4, "All the rights of a person.")]
    got = {r.doc_id: r.families for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: ["Proprietary"], 2: ["CC-BY-SA"], 3: ["Proprietary"]}


def test_license_scan_against_plain_rules(spark):
    """Lines and runs of invented files judged one by one in Python, without gate words."""
    families, grams, weights, bias = licenses.trained()
    index, rng = {g: i for i, g in enumerate(grams)}, random.Random(11)

    def judged(text):
        w = licenses.words_of(text)
        z = bias + sum((weights[index[g]] for g in licenses.grams_of(w) if g in index), np.zeros(len(families)))
        best = families[int(np.argmax(z))]
        if len(w) < 2 or best == licenses.UNKNOWN or np.exp(z - z.max()).sum() > 1 / licenses.MIN_PROBABILITY:
            return None
        enough = [t for t in licenses.TEMPLATES[best] if len(licenses.pairs_of(t) & licenses.pairs_of(text)) / len(licenses.pairs_of(t)) >= licenses.COVERAGE]
        if not enough:
            return None
        short = [licenses.words_of(t) for t in licenses.TEMPLATES[best] if len(licenses.words_of(t)) <= licenses.SHORT]
        sure = any(len(licenses.words_of(t)) > licenses.SHORT for t in enough)
        return best if sure or any(in_order(w, t) for t in short) or best == "Proprietary" and re.search(r"all rights reserved(?! [a-z])", " ".join(text.lower().split(" "))) else None

    def in_order(words, template):
        """Whether some 60 % of a template's pairs stand in order, at most three words between two of its words."""
        if "rights" in template:
            return False
        n = math.ceil(0.6 * (len(template) - 1)) + 1
        for i in range(len(template) - n + 1):
            ends = {k for k, w in enumerate(words) if w == template[i]}
            for t in template[i + 1 : i + n]:
                ends = {k for e in ends for k in range(e + 1, e + 5) if k < len(words) and words[k] == t}
            if ends:
                return True
        return False

    def scanned(text):
        lines, found, runs, run = text.lower().split("\n"), {}, [], []
        for x in lines:
            if family := judged(x):
                found[x] = family
        for x in [*lines, ""]:
            if x in found or not re.search("[a-z0-9]", x):
                runs, run = [*runs, run], []
            else:
                run = [*run, x]
        for run in runs:
            if len(run) > 1 and (family := judged("\n".join(run))):
                found["\n".join(run)] = family
        return sorted(set(found.values())), len(found)

    notices, data = [t for ts in licenses.TEMPLATES.values() for t in ts], []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            t = rng.choice(notices + licenses.EVERYDAY)
            parts.append(rng.choice([t, "\n".join(textwrap.wrap(t, rng.choice([30, 60]))), t.upper(), " ".join(t.split()[: rng.randint(1, 9)])]))
        data.append((i, rng.choice(["\n", "\n\n", "\n--\n"]).join(parts)))
    want = {i: found for i, t in data if (found := scanned(t))[1]}
    got = {r.doc_id: (r.families, r.n_paragraphs) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want and len(want) > 30


def test_license_notices_wrapped_over_lines(spark):
    grants = {f: max(licenses.TEMPLATES[f], key=len) for f in ("MIT", "ISC", "GPL", "CC0")} | {"BSD": licenses.TEMPLATES["BSD"][2]}
    prose = "\n".join(" ".join(random.Random(i).choices(sum(map(licenses.words_of, licenses.EVERYDAY), []), k=12)) for i in range(40))
    data = []
    for i, (family, t) in enumerate(sorted(grants.items())):
        wrapped = textwrap.wrap(t, 60)
        data += [(10 * i, "\n".join(wrapped)), (10 * i + 1, "int x;\n\n" + "\n".join(" * " + x for x in wrapped) + "\n *\n * end\n"), (10 * i + 2, f"{prose}\n" + "\r\n".join(wrapped) + f"\n{prose}")]
    data += [(90, prose), (91, "Released under the MIT License.\n\n" + "\n".join(textwrap.wrap(grants["ISC"], 60)))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    want = {10 * i + j: [f] for i, f in enumerate(sorted(grants)) for j in range(3)} | {91: ["ISC", "MIT"]}
    assert {i: r.families for i, r in got.items()} == want
    assert got[91].n_paragraphs == 2


PROSE = """Her MIT license plate was released under the sofa.
Not all rights reserved seats were taken.
All rights reserved seats are at the front.
He released the brake under the bridge, and the MIT student showed her license.
The license of the driver from MIT was under the seat when the dog was released.
The BSD license plates were counted, the birds released under the moon.
The Apache scouts held a license for version 2.0 of the map, licensed by nobody under the sun.
A copy of the license was obtained at the office; you may call them.
The public license office, version 3 of the building, was licensed under protest by the general.
The Mozilla source was subject to debate, and the public terms were never a license.
This work by the author is related to the rights of neighbours, to some extent possible.
The creative work of the commons is licensed to the international team.
Permission is hereby asked to use the room, free of worry, by the person in charge.
The above notice and the copyright office share all of the software money.
No part of the cake may be eaten without the written word of the cook.
The free software library was redistributed among schools under new terms by the general public.
We licensed the patent under CC, by post, and paid 4.0 euros.
The ISC released its report; the license is under review.""".split("\n")


def test_prose_with_the_pairs_of_notices(spark):
    """Lines that hold most word pairs of a short template, but in another order or far apart, are no notices."""
    lines, filler = list(PROSE), "quietly during some long winter months"
    for words in (licenses.words_of(t) for ts in licenses.TEMPLATES.values() for t in ts if len(licenses.words_of(t)) <= licenses.SHORT and "rights" not in t):
        half = len(words) // 2
        lines += [" ".join([*words[half:], filler, *words[:half]]), " ".join([*words[:half], filler, *words[half:]])]
    assert len(lines) > 50
    data = [(i, f"Some prose.\n\n{x}\n\nMore prose.") for i, x in enumerate(lines)]
    assert [(lines[r.doc_id], r.families) for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()] == []
    kept = ["Licensed under the terms of the MIT license.", "Available under CC BY-SA 4.0.", "(c) 2020 Someone. All rights reserved.", "All rights reserved by the author", "ALL RIGHTS RESERVED", "# SPDX-License-Identifier: MIT"]
    data = [(i, f"Some prose.\n{x}\nMore prose.") for i, x in enumerate(kept)]
    assert {r.doc_id for r in licenses.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()} == set(range(len(kept)))


def test_notices_that_most_documents_have(spark, monkeypatch):
    """Joins by the notice and by the text give the same rows where their tables are too large to broadcast."""
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts][:6]
    data = [(i, f"prose {i % 9}\n{notices[i % 2]}\n{notices[i % 6]}") for i in range(1200)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = sorted(map(str, licenses.scan(docs).collect()))
    monkeypatch.setattr(licenses, "BROADCAST", 0)
    assert sorted(map(str, licenses.scan(docs).collect())) == want and len(want) == 1200


def test_pipeline_keeps_texts_without_a_learnt_profile(spark):
    data = [(i, "some words of prose", None) for i in range(8)] + [(20, "12 34", None), (21, None, None), (22, "", None)]
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame(data, "doc_id long, text string, lang string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(8))


def test_pipeline_mixes_whole_documents(spark, docs):
    texts = {(i, t) for i, t, *_ in rows()}
    mixed = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    assert {x[:2] for x in mixed} <= texts
    cut = [(r.doc_id, r["size"], r.source_size, c.words) for r in mixing.plan(docs).collect() for c in r.copies if c.words < r["size"]]
    assert cut
    left, want = sum(len(words(t)) for _, t, _ in mixed), sum(r.taken for r in mixing.plan(docs).collect())
    assert left - want == sum(size - n if 2 * n >= size else -n for _, size, _, n in cut)


def test_lines_of_texts_with_much_boilerplate(spark, monkeypatch):
    """Texts with more boilerplate lines than are compared one by one give what few lines at a time do."""
    rng = random.Random(8)
    shared = [f"shared line {i}" for i in range(40)]
    table = []
    for i in range(14):
        lines = rng.sample(shared, 38) + [f"own line {i}", "", " "] + rng.choices(shared, k=5)
        rng.shuffle(lines)
        table += [(i, "\n".join(lines), f"s{i}")] * (3 if i == 4 else 1)
    docs = spark.createDataFrame([*table, (50, "\n".join(shared), "s1"), (51, None, "s2"), (52, "own", "s3")], "doc_id long, text string, source string")
    found = {}
    for few in (1000, 3):
        monkeypatch.setattr(linededup, "FEW_LINES", few)
        found[few] = sorted(map(tuple, linededup.report(docs).collect()))
    assert found[3] == found[1000]
    assert sum("own line" in r[-1] and "shared" not in r[-1] for r in found[3] if r[-1]) == 16


def test_a_text_of_very_many_shared_lines(spark):
    lines = [f"line number {i} of the notice" for i in range(200_000)]
    docs = spark.createDataFrame([(i, "\n".join([*lines, f"own {i}"]), f"s{i}") for i in range(10)], "doc_id long, text string, source string").repartition(4)
    found = linededup.report(docs).collect()
    assert {(r.n_lines, r.n_removed, r.text) for r in found} == {(200_001, 200_000, f"own {i}") for i in range(10)}


ODD = ["a.b", "order", "text_key", "__sh_own", "__sh_id", "__li_lang", "__ld_lines", "__row", "x`y", "key"]


def test_columns_of_any_name(spark):
    """Columns with dots, back quotes and the operators' own names pass through, and change nothing."""
    table = [(i, t, g, s, len(t or ""), *[f"{c}{i}" for c in ODD]) for i, t, g, s, *_ in rows()[:70]]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in ODD)
    odd = spark.createDataFrame(table, kind).repartition(3)
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for work in (langid.keep_identified, linededup.remove_lines, lambda d: simhash.keep_one(d, null_ids=True), lambda d: mixing.mix(d, whole=True)):
        got, want = work(odd), work(plain)
        assert got.columns == odd.columns
        kept = got.collect()
        assert sorted(map(str, (tuple(r)[:5] for r in kept))) == sorted(map(str, map(tuple, want.collect())))
        assert all(tuple(r)[5:] == tuple(f"{c}{r.doc_id}" for c in ODD) for r in kept)
    path, own = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
    for work in (lambda d: mixing.plan(d).drop("copies"), lambda d: bpe.encode_documents(d, path, P.PATTERN), simhash.near_duplicates, langid.detect, licenses.scan, linededup.report, lambda d: sstable.encode_to_shards(d, own)):
        assert sorted(map(str, work(odd).collect())) == sorted(map(str, work(plain).collect()))
