"""Operators on documents against brute force, on awkward rows and on the small tables."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from paragraphs import FOREIGN as FOREIGN_TEXTS
from paragraphs import KNOWN

from auditloom.llm import bitpack, isomedia, langid, linear, nbsvm, ngram_join, order_minhash, packing, spm_fst, tokens, toxicity

SF = "/root/testdata/sf0.001"
BYTES, WORDS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, extra string, sequence_id int, score string"


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def awkward_rows():
    random.seed(4)
    words = "the of and Ärger niño don't l'été 日本 ½ x\u0301 !!! $$$".split()
    long = " ".join(random.choice(words) + str(random.randint(0, 99)) for _ in range(4000))
    texts = [None, "", " \t\n", "one", "a b c d", "don't  stop\n\tnow\x1c!", "\x00 end", "x" * 5000, long, long + " tail", "same words again and again and again here", "same words again and again and again here", "🙂 emoji only", "12345 --- 678"]
    rows = [(i, t, "en" if i % 2 else None, "s", None, "e", 1, "z") for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, "no id at all here", None, None, None, None, None, None), (-5, "negative id", "en", "s", 1, "e", 1, "z")]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENT)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


# ------------------------------------------------------------------ tokens, packing, files


@pytest.mark.parametrize(("path", "words"), [(BYTES, False), (WORDS, True)])
def test_chunked_ids_are_those_of_the_library(path, words):
    random.seed(3)
    pieces = ["a", "The", "don't", "IT'S", " ", "  ", "\n", "\t", "É", "日本", "\u0301", "Σ", "ΑΣ", "İ", "!", "'", "$$$", "123", "_", "\x1c", "\x85", "\u3000", "x'", "!!'ll", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "|>"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 12))) for _ in range(4000)]
    expected = [np.asarray(e.ids, dtype="<u4").tobytes() for e in library(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.ChunkTokenizer(path, words).encode(texts) == expected
    assert tokens.ChunkTokenizer(path, words).encode([None]) == [b""]


class Counted:
    """The library, with a count of the texts that it is given."""

    def __init__(self, found):
        self.found, self.texts = found, 0

    def encode(self, text, **more):
        self.texts += 1
        return self.found.encode(text, **more)

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.found.encode_batch_fast(texts, **more)


def test_new_words_go_to_the_library_many_at_a_time():
    random.seed(9)
    words = sorted({"".join(random.choice("abcdeéüñst") for _ in range(random.randint(1, 60))) for _ in range(5000)})
    coder = tokens.ChunkTokenizer(WORDS, True)
    coder.library = Counted(coder.library)
    got = coder.encode([" ".join(words), ", ".join(words)])
    assert got == [np.asarray(library(WORDS).encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in (" ".join(words), ", ".join(words))]
    assert coder.library.texts < len(words) / 50


def test_words_beside_wide_marked_and_special_texts():
    texts = ["J\u030c H\u0331, K\u212a ß. ÀÞ×÷", None, "A.B,c don't.stop 's.x l'été!a", " \x1c.a\x1f b\x85c\u2028d\xa0e ", "<|ENDOFTEXT|> É", "ok", "<|endoftext|>日本", "", "\n", "Ünï.日本,x a\u0301.b", "a" * 9000 + ".b"]
    coder = tokens.ChunkTokenizer(WORDS, True)
    expected = [library(WORDS).encode(x or "", add_special_tokens=False).ids for x in texts]
    for rows, wanted in ((texts, expected), (texts[::-1], expected[::-1]), ([], []), ([None], [[]])):
        for kind in (pa.string(), pa.large_string()):
            ids, offsets = coder.encode_array(pa.array(["cut off", *rows], type=kind).slice(1), np.asarray([2], dtype="<u4").tobytes())
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[*x, 2] for x in wanted]


def test_words_that_lack_an_end_are_encoded_one_by_one(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    for suffix in ({"end_of_word_suffix": "</w>"}, {}):
        vocabulary = {x: i for i, x in enumerate(["a", "b", "a</w>", "ab", "ab</w>", "b</w>", "c"])}
        made = Tokenizer(models.BPE(vocabulary, [("a", "b"), ("a", "b</w>")], **suffix))
        made.pre_tokenizer = pre_tokenizers.Whitespace()
        made.save(str(tmp_path / "small.json"))
        texts = ["ab a b aab", "ac ca ab", "", "c"]
        expected = [np.asarray(made.encode(x).ids, dtype="<u4").tobytes() for x in texts]
        assert tokens.ChunkTokenizer(str(tmp_path / "small.json"), True).encode(texts) == expected


def test_packing_places_every_id_once(awkward):
    rows = packing.harmonic_pack(awkward, BYTES).collect()
    ids = {r[0]: np.asarray(library(BYTES).encode(r[1] or "", add_special_tokens=False).ids + [1], dtype="<u4") for r in awkward_rows()}
    spans, sequences = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        spans.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {k: sum(n for _, n in v) for k, v in spans.items()} == {k: len(v) * (2 if k == 8 else 1) for k, v in ids.items()}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # no padding


def test_ids_of_special_strings_are_those_of_the_library():
    assert np.frombuffer(tokens.ChunkTokenizer(BYTES).encode(["a <|endoftext|> b"])[0], dtype="<u4").tolist() == library(BYTES).encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    assert 49407 in np.frombuffer(tokens.ChunkTokenizer(WORDS, True).encode(["Ends here<|endoftext|>"])[0], dtype="<u4")


def test_documents_of_less_than_a_sequence_stay_whole():
    random.seed(6)
    sizes = {i: max(1, int(random.lognormvariate(5.5, 1.2))) for i in range(3000)}
    packer, rows = packing.SequencePacker(2048, 7), []
    for i, n in sizes.items():
        rows += packer.add(i, np.arange(n, dtype="<u4").tobytes())
    rows += packer.flush()
    pieces, sequences = {}, {}
    for doc, start, length, crc, n, number, offset in rows:
        assert n == sizes[doc] and crc == zlib.crc32(np.arange(start, start + length, dtype="<u4").tobytes()) and number >= 7
        pieces.setdefault(doc, []).append((start, length))
        sequences.setdefault(number, []).append((offset, length))
    for places, whole in [(p, sizes[d]) for d, p in pieces.items()] + [(s, sum(x for _, x in s)) for s in sequences.values()]:
        at = 0
        for begin, length in sorted(places):
            assert begin == at
            at += length
        assert at == whole
    assert len(pieces) == len(sizes) and all(n == 2048 or n & (n - 1) == 0 for n in (sum(x for _, x in s) for s in sequences.values()))
    assert sum(sum(x for _, x in s) < 2048 for s in sequences.values()) <= 11
    short = [len(p) for d, p in pieces.items() if sizes[d] <= 2048]
    assert np.mean(np.array(short) == 1) > 0.97 and len(rows) < len(sizes) + len(sequences)


def test_operators_leave_the_rows_of_batches_alone(spark, awkward):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    bitpack.token_files(awkward, WORDS)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_harmonic_classes_hold_a_fixed_count():
    bins = packing.HarmonicBins(100)
    closed = [x for i, n in enumerate([40, 60, 45, 34, 50, 33, 33, 33, 100]) for x in bins.add(n, i)]
    by_bin = {}
    for piece, number, offset in closed:
        by_bin.setdefault(number, []).append((piece, offset))
    assert by_bin == {0: [(1, 0)], 1: [(0, 0), (2, 40)], 2: [(3, 0), (4, 34)], 3: [(5, 0), (6, 33), (7, 66)], 4: [(8, 0)]}
    assert list(bins.flush()) == []


def test_packing_of_no_rows(empty):
    assert packing.harmonic_pack(empty, BYTES).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64)
    assert (bitpack.unpack_ids(bitpack.pack_ids(ids, bits), bits, len(ids)) == ids).all()


def test_token_file_random_access():
    ids = np.random.default_rng(0).integers(0, 49408, 1000)
    file = bitpack.TokenFile(bitpack.file_image([7, None], [400, 600], ids, 16, block_ids=64))
    assert file.doc_ids == [7, None] and file.n_blocks == 16
    assert (file.ids() == ids).all() and (file.ids(63, 130) == ids[63:130]).all()
    assert (file.document(1) == ids[400:]).all() and len(file.ids(5, 5)) == 0
    with pytest.raises(ValueError):
        bitpack.TokenFile(b"x" * 64)


def test_token_files_hold_all_documents_in_order(awkward, empty):
    got = sorted(bitpack.token_files(awkward, WORDS).collect(), key=lambda r: r.start)
    expected, at = [], 0
    for r in sorted(awkward_rows(), key=lambda r: -(1 << 70) if r[0] is None else r[0]):
        ids = np.asarray(library(WORDS).encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4")
        expected.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected
    assert bitpack.token_files(empty, WORDS).count() == 0


# ------------------------------------------------------------------ fingerprints


def slow_signature(method, text):
    """Order MinHash word for word: sort all pairs for every sketch."""
    kmers = method.kmers(text)
    seen, occurrence = {}, []
    for k in kmers.tolist():
        occurrence.append(seen.get(k, 0))
        seen[k] = occurrence[-1] + 1
    pairs = linear.mixed(kmers + (np.array(occurrence, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    out = []
    for m in method.multipliers:
        best = sorted(sorted(range(len(pairs)), key=lambda i: (int(pairs[i] * m), i))[: method.length])
        h = np.array([m])
        for i in best:
            h = linear.mixed(h * np.uint64(31) + kmers[i : i + 1])
        out.append(int(h[0] >> np.uint64(48)))
    return out


@pytest.mark.parametrize("text", ["", "ab", "abcabcabcabcabc", "The quick brown fox jumps over the lazy dog. The quick brown fox."])
def test_signature_is_the_slow_one(text):
    method = order_minhash.OrderMinHash(sketches=16)
    with np.errstate(over="ignore"):
        assert method.signature(text).tolist() == slow_signature(method, text)


def test_likeness_follows_order_and_edits():
    method = order_minhash.OrderMinHash()
    like = lambda a, b: float((method.signature(a) == method.signature(b)).mean())
    random.seed(1)
    words = ["".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text, swapped = " ".join(words), " ".join(words[150:] + words[:150])
    one_edit = text[:700] + "zz" + text[702:]
    assert like(text, text) == 1 and like(text, one_edit) > 0.8
    assert like(text, swapped) < like(text, one_edit) and like(text, " ".join(reversed(words))) < 0.9


def test_fingerprints_of_neighbours(awkward, empty):
    rows = order_minhash.fingerprints(awkward, shards=5).collect()
    order = sorted(((r[0], r[1] or "") for r in awkward_rows()), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1].encode()))
    expected = []
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        expected.append((str(doc), len(text), hashlib.sha256(order_minhash.edited_text(text, following).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in rows) == sorted(expected)
    same = {r.fingerprint for r in rows if r.doc_id in (10, 11)}
    assert len(same) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert order_minhash.fingerprints(empty).count() == 0


# ------------------------------------------------------------------ n-gram join


def brute_force_groups(rows, words=5):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        found = word.findall((text or "").translate(lower))
        sets.append({tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 75 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None) for g in set(group) if any(r[0] is not None and h == g for r, h in zip(rows, group, strict=True))}
    return sorted((str(r[0]), len(s), str(None if r[0] is None else least[g])) for r, s, g in zip(rows, sets, group, strict=True))


def near_copies(seed, copies):
    random.seed(seed)
    base = [f"w{random.randint(0, 999)}" for _ in range(60)]
    rows = []
    for i in range(copies):
        text = list(base)
        for _ in range(random.randint(0, 4)):
            text[random.randrange(60)] = f"v{random.randint(0, 99999)}"
        rows.append((i, " ".join(text[: random.randint(50, 60)])))
    rows += [(1000 + i, " ".join([f"u{random.randint(0, 99999)}" for _ in range(40)] + base[:40])) for i in range(30)]  # a shared passage
    return rows


@pytest.mark.parametrize(("seed", "part_rows"), [(1, ngram_join.PART_ROWS), (2, 64), (3, 7)])
def test_groups_of_near_copies_are_those_of_brute_force(spark, seed, part_rows):
    rows = near_copies(seed, 120)
    got = ngram_join.ngram_groups(spark.createDataFrame(rows, "doc_id long, text string"), part_rows=part_rows).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_force_groups(rows)


def test_groups_of_awkward_rows(awkward, empty):
    got = ngram_join.ngram_groups(awkward).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_force_groups([r[:2] for r in awkward_rows()])
    assert ngram_join.ngram_groups(empty).count() == 0


def test_one_of_each_group_stays(awkward):
    kept = ngram_join.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted(str(i) for i in (None, -5, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 13))


def test_rows_of_one_doc_id_are_judged_by_their_groups(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one, 1), (2, one, 2), (2, two, 3), (2, two + " end", 4), (2, two, 2), (3, two, 5), (4, three, 6), (4, None, 7), (4, None, 1), (4, "", 8), (5, None, 9)]
    docs = spark.createDataFrame([(i, t, {"n": n}, n) for i, t, n in rows], "doc_id long, text string, props map<string,int>, _again int")
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.props["n"]) for r in kept.collect()) == [(1, one, 1), (2, two, 2), (4, "", 1), (4, three, 6), (5, "", 9)]


def test_bitmaps_bound_the_difference():
    random = np.random.default_rng(2)
    for _ in range(50):
        a = np.unique(random.integers(0, 1 << 62, random.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([a[random.random(len(a)) < 0.8], random.integers(0, 1 << 62, 20, dtype=np.uint64)]))
        assert ngram_join.least_difference(ngram_join.parity_bits(a), ngram_join.parity_bits(b)) <= len(np.setxor1d(a, b))


# ------------------------------------------------------------------ classifiers


def test_languages_are_learned(spark, awkward, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.predict_languages(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.9
    odd = {r.doc_id: r for r in langid.predict_languages(awkward).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 and odd[i].rejected for i in (0, 1, 2, 13)) and odd[4].lang_pred == "en"
    assert langid.predict_languages(empty).count() == 0


def slow_hash(code: int) -> int:
    """The finaliser of ``mixed`` on one number."""
    mask = (1 << 64) - 1
    for _ in range(2):
        code = (code ^ code >> 32) * 0xD6E8FEB86659FD93 & mask
    return code ^ code >> 32


def slow_buckets(grams, text):
    """The buckets of all n-grams of one text, one by one."""
    data = (text.lower() if grams.letters else text).encode()
    if grams.letters:
        data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in data)
    found = []
    for n in grams.orders:
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if grams.letters and gram[:2] == b"  " and n > 1:
                continue
            found.append(slow_hash((int.from_bytes(gram, "big") + (n << 57)) & (1 << 64) - 1) >> (64 - grams.bits))
    return found


TEXTS = ["", "a", "Ab  c-d", "don't  Stop!! ", "Été à l'île", "x\n\n y", "日本 語", "the of the of"]


@pytest.mark.parametrize("grams", [langid.GRAMS, toxicity.GRAMS, nbsvm.GRAMS])
def test_buckets_are_the_slow_ones(grams):
    import pyarrow as pa

    found = [[] for _ in TEXTS]
    for number, bucket in grams.buckets(pa.array(TEXTS)):
        for i, b in zip(number.tolist(), bucket.tolist(), strict=True):
            found[i].append(b)
    assert [sorted(f) for f in found] == [sorted(slow_buckets(grams, t)) for t in TEXTS]


def test_language_scores_are_the_slow_ones(spark):
    import pyarrow as pa

    model = langid.fit_languages(spark.read.parquet(f"{SF}/documents.parquet"))
    z, count, share, typical = model.averages(pa.array([*TEXTS, *TEXTS[::-1]]))
    for i, text in enumerate([*TEXTS, *TEXTS[::-1]]):
        own = slow_buckets(langid.GRAMS, text)
        seen = [b for b in own if model.seen[b]]
        mean = sum((model.logits[b >> 6].astype(float) for b in seen), np.zeros(len(model.languages))) / max(1, len(seen)) + model.bias
        assert count[i] == len(own) and abs(share[i] - len(seen) / max(1, len(own))) < 1e-12 and np.abs(z[i] - mean).max() < 1e-9
        frequent = sum((model.shares[model.typical[b]] for b in own), np.zeros(len(model.languages))) / max(1, len(own))
        assert np.abs(typical[i] - frequent).max() < 1e-9
    assert (z[: len(TEXTS)] == z[len(TEXTS) :][::-1]).all()  # equal texts, whatever stands beside them
    language, score, rejected, _ = model.predict(pa.array(TEXTS))
    p = langid.softmax(z[: len(TEXTS)] / model.temperature)
    for i, text in enumerate(TEXTS):
        if not any(map(str.isalpha, text)):
            assert (language[i], score[i], rejected[i]) == ("und", 0, True)
        else:
            first, second = sorted(z[i])[::-1][:2]
            near = (typical[i][z[i].argmax()] * count[i] + 3 * model.usual[0]) / (count[i] + 3)
            lead = ((first - second) * share[i] * count[i] + 3 * model.usual[1]) / (count[i] + 3)
            known = min(1, lead / model.lead) / (1 + np.exp(-model.known[0] * near - model.known[1]))
            assert language[i] == model.languages[p[i].argmax()] and abs(score[i] - p[i].max() * known) < 1e-12 and rejected[i] == (score[i] < 0.5)


FOREIGN = ["これは日本語の文章です。とても長いです。", "Это предложение написано на русском языке.", "Questa frase è scritta in italiano, e non dovrebbe essere accettata dal modello.", "def f(x):\n    return [i for i in range(x)]\nimport os, sys\nprint(os.path)", "zzqx wvk jjhh pqz xxk vvb"]


def test_foreign_texts_are_rejected_and_known_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(10_000_000 + i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    rows = langid.predict_languages(docs.unionByName(more)).collect()
    assert all(r.rejected for r in rows if r.doc_id >= 10_000_000)
    assert np.mean([not r.rejected for r in rows if r.doc_id < 10_000_000]) >= 0.98
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(more)).select("doc_id").collect()}
    assert kept == {r.doc_id for r in rows if not r.rejected}


def test_real_paragraphs_of_known_languages_stay_and_others_go(spark):
    import pyarrow as pa

    model = langid.fit_languages(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert 0.1 < model.temperature < 10  # within its grid
    kept, gone = [], []
    for language, texts in KNOWN.items():
        found, score, rejected, _ = model.predict(pa.array(texts))
        assert (found == language).all()
        kept += list(zip(rejected, score, strict=True))
    for texts in FOREIGN_TEXTS.values():
        _, score, rejected, _ = model.predict(pa.array(texts))
        gone += list(zip(rejected, score, strict=True))
    assert np.mean([not r for r, _ in kept]) >= 0.95 and np.mean([r for r, _ in gone]) >= 0.9
    assert max(s for r, s in kept + gone if r) < min(s for r, s in kept + gone if not r)


def test_descent_is_the_slow_one():
    random = np.random.default_rng(3)
    rows = [np.unique(random.integers(0, 50, 8)) for _ in range(12)]
    counts = [random.integers(1, 4, len(r)).astype(float) for r in rows]
    y = random.integers(0, 3, 12)
    logits, bias = langid.descend(rows, counts, y, 3, epochs=2, rate=0.5)
    start = np.random.default_rng(11)
    embedding = start.normal(0, 1 / langid.WIDTH, (1 << langid.EMBEDDED_BITS, langid.WIDTH))
    layer, shift = start.normal(0, 1 / np.sqrt(langid.WIDTH), (langid.WIDTH, 3)), [0.0] * 3
    step = 0
    for _ in range(2):
        for i in start.permutation(12):
            now, step = 0.5 * (1 - step / 24), step + 1
            share = counts[i] / counts[i].sum()
            hidden = [sum(s * embedding[r][d] for r, s in zip(rows[i], share, strict=True)) for d in range(langid.WIDTH)]
            z = [sum(hidden[d] * layer[d][c] for d in range(langid.WIDTH)) + shift[c] for c in range(3)]
            e = [np.exp(v) for v in z]
            error = [v / sum(e) - (c == y[i]) for c, v in enumerate(e)]
            back = [sum(layer[d][c] * error[c] for c in range(3)) for d in range(langid.WIDTH)]
            for d in range(langid.WIDTH):
                for c in range(3):
                    layer[d][c] -= now * hidden[d] * error[c]
                for r, s in zip(rows[i], share, strict=True):
                    embedding[r][d] -= now * 20 * s * back[d]
            shift = [b - 0.1 * now * v for b, v in zip(shift, error, strict=True)]
    assert np.abs(logits - embedding @ layer).max() < 1e-5 and np.abs(bias - shift).max() < 1e-9


@pytest.mark.parametrize("labelled", [(), ("en",), ("en", "de")])
def test_few_languages_to_learn_from(spark, labelled):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = ",".join(f"'{x}'" for x in (*labelled, "-"))
    rows = langid.predict_languages(docs.selectExpr("doc_id", "text", f"case when lang in ({known}) then lang end as lang")).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert {r.lang_pred for r in rows} <= {*labelled, "und"} and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([not r.rejected for r in rows if truth[r.doc_id] in labelled] or [1]) >= 0.95


@pytest.mark.parametrize("left_out", ["de", "es", "fr"])
def test_a_language_that_training_lacks_is_rejected(spark, left_out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rest = docs.selectExpr("doc_id", "text", f"case when lang <> '{left_out}' then lang end as lang")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.predict_languages(rest).collect()
    assert np.mean([r.rejected for r in rows if truth[r.doc_id] == left_out]) >= 0.9
    assert np.mean([not r.rejected for r in rows if truth[r.doc_id] != left_out]) >= 0.98


@pytest.fixture(scope="module")
def marked(spark):
    random.seed(9)
    words = ["".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(600):
        text = [random.choice(words) for _ in range(60)]
        toxic, bad = int(i % 5 == 0), int(i % 4 == 1)
        if toxic:
            text[random.randrange(60)] = "Vileword"
        if bad:
            text = [w + "!!" if random.random() < 0.5 else w for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, 1 - bad, toxic))
    labels += [(1, None, None), (2, 7, 7), (None, 1, 1), (10_000, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels[:600]}


@pytest.mark.parametrize(("score", "column", "modulus", "remainder"), [(toxicity.toxicity, 2, 3, 1), (nbsvm.quality, 1, 5, 0)])
def test_classifiers_on_held_out_rows(marked, score, column, modulus, remainder):
    docs, labels, truth = marked
    rows = score(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id][column] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("score", [toxicity.toxicity, nbsvm.quality])
def test_classifiers_on_awkward_rows(spark, awkward, empty, marked, score):
    rows = score(awkward, marked[1]).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert score(empty, marked[1]).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score(awkward, none).collect()} <= {0.0, 1e-9}


@pytest.mark.parametrize(("grams", "labelled"), [(toxicity.GRAMS, 2), (nbsvm.GRAMS, 1)])
def test_ratios_and_scores_are_the_slow_ones(marked, grams, labelled):
    import pyarrow as pa

    docs, _, truth = marked
    rows = sorted((r.doc_id, r.text) for r in docs.limit(120).collect())
    y = np.array([truth[i][labelled] for i, _ in rows])
    sets = [set(slow_buckets(grams, t)) for _, t in rows]
    buckets, ratio = linear.select_buckets([np.array(sorted(x)) for x in sets], y, grams.bits, 50)
    n = [sum(y == c) + 2.0 for c in (0, 1)]
    slow = {}
    for b in set().union(*sets):
        seen = [sum(b in x for x, t in zip(sets, y, strict=True) if t == c) for c in (0, 1)]
        if sum(seen) >= 4:
            r = np.log((seen[1] + 1) / n[1]) - np.log((seen[0] + 1) / n[0])
            slow[b] = (abs(r) / np.sqrt(1 / (seen[0] + 1) + 1 / (seen[1] + 1)), r)
    least = sorted(s for s, _ in slow.values())[-len(buckets)]
    assert len(buckets) == min(50, sum(s > 0 for s, _ in slow.values()))
    assert all(abs(slow[b][1] - r) < 1e-9 and slow[b][0] >= least - 1e-12 for b, r in zip(buckets.tolist(), ratio, strict=True))
    weights = np.linspace(-1, 1, len(buckets))
    model = linear.IndicatorModel(grams, linear.bucket_table(buckets, grams.bits), weights, 0.25, 2.0, -0.5)
    for score, x in zip(model.scores(pa.array([t for _, t in rows])), sets, strict=True):
        decision = sum(w for b, w in zip(buckets.tolist(), weights, strict=True) if b in x) + 0.25
        assert abs(score - 1 / (1 + np.exp(-(2 * decision - 0.5)))) < 1e-9


def test_calibration_is_the_likelihood_optimum():
    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(int)
    z, weight = 3 * (y - 0.4) + rng.normal(size=400), np.where(y == 1, 2.0, 1.0)
    a, b = linear.fit_platt(z, y, weight)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    loss = lambda a, b: -(weight * (target * np.log(linear.sigmoid(a * z + b)) + (1 - target) * np.log(1 - linear.sigmoid(a * z + b)))).sum()
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-2 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    random = np.random.default_rng(0)
    dense = (random.random((80, 6)) < 0.5).astype(float)
    y = (dense @ [2, -1, 0.5, 0, 1, -2] + 0.3 * random.normal(size=80) > 0.3).astype(int)
    rows = linear.Rows(np.r_[0, np.cumsum(dense.sum(1))].astype(int), np.nonzero(dense)[1], np.ones(int(dense.sum())), 6)
    w, b = linear.fit_hinge_dual(rows, y, c=0.5, epochs=500, tolerance=1e-6)
    sign = np.where(y == 1, 1, -1)
    cost = 0.5 * np.where(y == 1, 40 / (y == 1).sum(), 40 / (y == 0).sum())
    primal = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * (dense @ w + b))).sum()
    best = primal(w, b)
    assert all(primal(w + 0.02 * random.normal(size=6), b + 0.02 * random.normal()) >= best - 1e-4 for _ in range(200))


# ------------------------------------------------------------------ SentencePiece


def test_pieces_are_those_of_the_library(awkward, empty):
    import sentencepiece

    model, machine = sentencepiece.SentencePieceProcessor(model_file=PIECES), spm_fst.PieceTransducer(PIECES)
    random.seed(1)
    parts = ["a", "e", "th", "the", "▁", " ", "  ", "      ", "é", "日", "🙂", "\n", "1", "23", "!!", "***", "ing", "http", "://", "<s>", "<0x0A>", "\u0301", "\x00", "Ω"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(3000)] + [" " * n + "x" for n in range(70)]
    for text in texts:
        ids = machine.encode(text)
        assert list(memoryview(ids).cast("I")) == model.encode(text)
        assert machine.decode(ids) == model.decode(model.encode(text))
    for row in spm_fst.encode_and_decode(awkward, PIECES).collect():
        text = next((r[1] for r in awkward_rows() if r[0] == row.doc_id), None) or ""
        ids = np.asarray(model.encode(text), dtype="<u4")
        assert (row.n_pieces, row.ids_crc32, row.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)
    assert spm_fst.encode_and_decode(empty, PIECES).count() == 0


def test_unigram_shortest_path_is_the_best_segmentation():
    machine = spm_fst.PieceTransducer.__new__(spm_fst.PieceTransducer)
    machine.merges = False
    machine.scores = {"a": -3.0, "b": -3.0, "c": -2.5, "ab": -2.0, "bc": -4.0, "abc": -9.0}
    machine.ids = {p: i for i, p in enumerate(machine.scores)}
    machine._meets, machine._met, machine.lexicon = {}, 0, machine.trie()

    def cuts(text):
        return [[]] if not text else [[text[:n], *rest] for n in range(1, len(text) + 1) if text[:n] in machine.ids for rest in cuts(text[n:])]

    for text in ("abc", "abcabc", "cab", "bcbc"):
        best = max(cuts(text), key=lambda c: sum(machine.scores[p] for p in c))
        assert sum(machine.scores[p] for p in machine.shortest_path(text)) == sum(machine.scores[p] for p in best)


# ------------------------------------------------------------------ media


@pytest.mark.parametrize("size", [64, 64 * 31, 64 * 1024, 64 * 1025, 64 * 5000])
def test_container_round_trip(size):
    payload = np.random.default_rng(size).bytes(size)
    container = isomedia.write_container(payload)
    (track,) = isomedia.read_tracks(container)
    assert isomedia.media_payload(container, track) == payload
    assert (track.codec, track.duration, track.timescale) == ("raw ", size // 64, 25)
    ranges = track.keyframe_ranges()
    assert len(ranges) == -(-size // 64 // 32)
    assert all(container[a:b] == payload[64 * 32 * i : 64 * 32 * i + 64] for i, (a, b) in enumerate(ranges))


def test_wide_boxes_and_bad_containers():
    payload = bytes(range(64))
    container = isomedia.write_container(payload)
    at = container.index(b"mdat") - 4
    wide = container[:at] + struct.pack(">I4sQ", 1, b"mdat", 80) + payload  # the data lies 8 bytes further on
    open_ended = container[:at] + struct.pack(">I4s", 0, b"mdat") + payload
    assert len(isomedia.read_tracks(wide)) == 1 and isomedia.media_payload(open_ended, isomedia.read_tracks(open_ended)[0]) == payload
    for bad in (container[:60], container[:at] + b"\xff" * 16, container.replace(b"stsz", b"stsz"[:3] + b"z")[:200]):
        with pytest.raises(ValueError):
            isomedia.read_tracks(bad)
        assert isomedia.features_of(1, 2, bad)[8] is None
    assert isomedia.features_of(1, None, None)[8] is None
    few = bytearray(container)
    few[container.index(b"stss") + 11] = 200  # a sync sample outside the track
    with pytest.raises(ValueError):
        isomedia.read_tracks(bytes(few))


def test_media_table(awkward, empty):
    for r in isomedia.media_table(awkward).collect():
        text = (next((x[1] for x in awkward_rows() if x[0] == r.doc_id), None) or "").encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > r.payload_bytes and r.feature.startswith("codec=raw;")
    assert isomedia.media_table(empty).count() == 0
