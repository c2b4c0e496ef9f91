import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorekeep.llm.bpe import SpeculativeBPE, bpe_decode, bpe_encode, model
from lorekeep.llm.matroska import FRAME, element, media_digest, number, packet_table, parse, read_vint, to_media, vint, write
from lorekeep.llm.rollup import TokenRollup, corpus_counts, signed

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", "Hello, world! I'll  we've\n\n\t x", "<|endoftext|> a<|endoftext|>", "日本語 текст 🙂🙂 é é", "   lead", "tail   ", " " * 4000 + "b", "ab" * 9000, "\x00\x01 \x7f", "word " * 300_000]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_equals_the_library():
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abcdefghiklmnorstuvw  '.,\n\tÀéß漢字1234_-<|>") for _ in range(rng.randrange(90))) for _ in range(1500)]
    mine, ref = model(PATH).encode_many(texts), library().encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(mine, ref))
    assert all(model(PATH).decode(a) == library().decode(b.ids, skip_special_tokens=False) for a, b in list(zip(mine, ref))[:200])


def test_long_words_equal_the_library():
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choice(x) for _ in range(n)) for n in (40, 49, 100, 5000, 30_000) for x in (letters, "abe", "漢字本語", "e", "0123456789")]
    texts += ["=" * 5000, "ing" * 4000, "abab" * 30 + "c" * 200]
    assert [a.tolist() for a in model(PATH).encode_many(texts)] == [b.ids for b in library().encode_batch(texts, add_special_tokens=False)]
    whole = "".join(rng.choice(letters) for _ in range(1_000_000))  # one word of a megabyte
    assert model(PATH).encode(whole).tolist() == library().encode(whole, add_special_tokens=False).ids


def test_the_longest_special_token_wins(tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["added_tokens"] = [{**spec["added_tokens"][0], "id": 50_257 + i, "content": c} for i, c in enumerate(("<|a", "<|ab|>"))]
    (tmp_path / "bpe.json").write_text(json.dumps(spec), encoding="utf-8")
    lib = Tokenizer.from_file(str(tmp_path / "bpe.json"))
    for t in spec["added_tokens"]:  # the library numbers them itself
        t["id"] = lib.token_to_id(t["content"])
    (tmp_path / "bpe.json").write_text(json.dumps(spec), encoding="utf-8")
    for text in ("x<|ab|>y", "<|ab", "<|a<|ab|>"):
        assert SpeculativeBPE(str(tmp_path / "bpe.json")).encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_columns(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", None), (2, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe_encode(df, PATH, digests=True).collect()
    lib = library()
    for r, (d, t, _) in zip(sorted(got, key=lambda r: repr((r.doc_id, r.n_tokens))), sorted(rows, key=lambda r: repr((r[0], len(lib.encode(r[1] or "", add_special_tokens=False).ids))))):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids) == (d, len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe_decode(bpe_encode(df, PATH), PATH)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe_encode(df.limit(0), PATH).count() == 0


def test_rollup(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 5), f"s{i % 3}" if i % 7 else None, "en") for i in range(60)] + [(60, None, "s0", None), (1, "text", "s1", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    r = TokenRollup(spark, str(tmp_path / "r"))
    got = {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in corpus_counts(docs, r, PATH).collect()}
    lib, want = library(), {}
    for _, t, s, lang in rows:
        for name, n in (("words-1", len((t or "").split())), ("byte_bpe_50k-1", len(lib.encode(t or "", add_special_tokens=False).ids))):
            a, b = want.get((s, lang, name), (0, 0))
            want[s, lang, name] = (a + 1, b + n)
    assert got == want
    assert {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in corpus_counts(docs, r, PATH).collect()} == want  # both batches are committed
    change = spark.createDataFrame([("delete", "s0", None, "words-1", 0, None), ("revise", "s1", "en", "words-1", 9, 4), ("insert", "new", "en", "words-1", 7, None)], "op string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    assert r.commit("third", signed(change)) and not r.commit("third", signed(change))
    now = {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in r.totals().collect()}
    assert now[("new", "en", "words-1")] == (1, 7) and ("s0", None, "words-1") not in now
    assert now[("s1", "en", "words-1")] == (want[("s1", "en", "words-1")][0], want[("s1", "en", "words-1")][1] + 5)
    with pytest.raises(ValueError):
        r.commit("../x", signed(change))
    with pytest.raises(Exception, match="unknown change"):
        r.commit("bad", signed(change.selectExpr("'upsert' as op", "source", "lang", "tokenizer", "tokens", "old_tokens")))
    assert not r.committed("bad")
    late = TokenRollup(spark, str(tmp_path / "r"))
    late.committed = lambda batch_id: False  # another writer that looked before the id was in place
    assert not late.commit("third", signed(change))
    assert {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in r.totals().collect()} == now


@pytest.mark.parametrize("lacing", ["none", "fixed", "xiph", "ebml"])
@pytest.mark.parametrize("size", [1, 3, 8, 17, 900])
def test_container(lacing, size):
    payload = random.Random(size).randbytes(size * FRAME)
    data = write(payload, lacing)
    m = parse(data)
    assert b"".join(data[p.offset : p.offset + p.size] for p in m.packets) == payload
    assert [p.timestamp_ns for p in m.packets] == [i * 72_000_000 for i in range(size)]
    assert m.doc_type == "matroska" and m.tracks == [{"number": 1, "kind": 2, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "depth": 8}]
    assert [c[2] for c in m.cues] == m.clusters and m.duration == size * 72


def test_laces_of_several_sizes():
    from lorekeep.llm.matroska import BLOCK, CLUSTER, EBML, GROUP, SEGMENT, TIMESTAMP, laced

    frames = [bytes([i]) * n for i, n in enumerate((700, 3, 255, 510, 1))]
    for kind in ("xiph", "ebml"):
        flags, body = laced(frames, kind)
        block = element(GROUP, element(BLOCK, b"\x81\x00\x05" + bytes([flags]) + body))
        unknown = SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + CLUSTER.to_bytes(4, "big") + b"\xff" + number(TIMESTAMP, 40) + block
        m = parse(element(EBML, b"") + unknown)
        data = element(EBML, b"") + unknown
        assert [data[p.offset : p.offset + p.size] for p in m.packets] == frames and m.packets[0].timestamp_ns == 45_000_000


def test_bytes_of_the_public_format():
    """A file laid out by hand from the format's specification, with cues, unlaced and Xiph-laced blocks."""
    e = lambda name, *body: bytes.fromhex(name) + (lambda b: bytes([0x80 | len(b)]) if len(b) < 127 else bytes([0x40 | len(b) >> 8, len(b) & 255]))(b"".join(body)) + b"".join(body)
    header = e("1A45DFA3", e("4286", b"\x01"), e("42F7", b"\x01"), e("42F2", b"\x04"), e("42F3", b"\x08"), e("4282", b"matroska"), e("4287", b"\x04"), e("4285", b"\x02"))
    info = e("1549A966", e("2AD7B1", b"\x0f\x42\x40"))
    track = e("1654AE6B", e("AE", e("D7", b"\x01"), e("83", b"\x02"), e("86", b"A_PCM/INT/LIT"), e("E1", e("B5", b"\x45\xfa\x00\x00"), e("9F", b"\x01"), e("6264", b"\x08"))))
    first = e("1F43B675", e("E7", b"\x0a"), e("A3", b"\x81\x00\x02\x80", b"abc"), e("A3", b"\x81\xff\xff\x02\x01\x02", b"xxyz"))
    second = e("1F43B675", e("E7", b"\x01\x00"), e("A0", e("A1", b"\x81\x00\x00\x00", b"tail")))
    at = len(info) + len(track)
    cues = e("1C53BB6B", *[e("BB", e("B3", t), e("B7", e("F7", b"\x01"), e("F1", bytes([p])))) for t, p in ((b"\x0a", at), (b"\x01\x00", at + len(first)))])
    data = header + e("18538067", info, track, first, second, cues)
    m = parse(data)
    assert m.doc_type == "matroska" and m.tracks[0] == {"number": 1, "kind": 2, "codec": "A_PCM/INT/LIT", "rate": 8000.0, "channels": 1, "depth": 8}
    assert [data[p.offset : p.offset + p.size] for p in m.packets] == [b"abc", b"xx", b"yz", b"tail"]
    assert [p.timestamp_ns // 1_000_000 for p in m.packets][0] == 12 and m.packets[1].timestamp_ns == 9_000_000 and m.packets[-1].timestamp_ns == 256_000_000
    assert [p.keyframe for p in m.packets][0] is True and [c[0] for c in m.cues] == [10, 256] and [c[2] for c in m.cues] == m.clusters


def plain_feature(payload, packets):
    x = [b - 128 for b in payload]
    quarter, extra = divmod(len(x), 4)
    ends = [0]
    for i in range(4):
        ends.append(ends[-1] + quarter + (i < extra))
    energy = [sum(v * v for v in x[a:b]) for a, b in zip(ends, ends[1:])]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    return f"packets={packets};", f"sum={sum(x)};crossings={crossings};energy={','.join(map(str, energy))}"


def test_feature_and_seek(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:9] + ["long text " * 3000])], "doc_id long, text string")
    digests = {r.doc_id: r for r in media_digest(docs).collect()}
    for r in packet_table(to_media(docs)).collect():
        raw = (r.text or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        head, tail = plain_feature(p, len(p) // 576)
        assert digests[r.doc_id].feature.startswith(head) and digests[r.doc_id].feature.endswith(tail)
        media = bytes(r.media)
        assert hashlib.sha256(media).hexdigest() == digests[r.doc_id].media_sha256
        # a seek: the last cue names a cluster, whose first packet has the cue's time
        m = parse(media)
        time, _, cluster = m.cues[-1]
        packet = next(x for x in r.packets if x.offset > cluster)
        assert packet.timestamp_ns == time * 1_000_000 and media[packet.offset : packet.offset + packet.size] == p[packet.timestamp_ns // 72_000_000 * 576 :][:576]


def test_variable_length_integers():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**21 - 2, 2**40):
        assert read_vint(vint(n), 0) == (n, len(vint(n)))
    assert read_vint(b"\xff", 0) == (None, 1)
    with pytest.raises(ValueError):
        read_vint(b"\x00\x00", 0)


def test_media(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a"), (2, "a"), (50, "x" * 576)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = media_digest(df).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r, (d, t) in zip(sorted(got, key=lambda r: repr((r.doc_id, r.n_bytes))), sorted(rows, key=lambda r: repr((r[0], len((r[1] or "").encode()))))):
        raw = (t or "").encode()
        p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert by_text.setdefault(t or "", (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    packets = packet_table(to_media(df)).selectExpr("doc_id", "size(packets) as n").where("doc_id = 50").first().n
    assert packets == 1 and media_digest(df.limit(0)).count() == 0


def test_the_encoder_forgets_words_before_they_are_many():
    """A worker's memory of words is bounded well below what its partition may hold."""
    import public_tokenizers
    from lorekeep.llm.bpe import SpeculativeBPE

    bpe = SpeculativeBPE(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{i:x}q" for i in range(at, at + 20_000)) for at in range(0, 200_000, 20_000)]
    most = 0
    for t in texts:
        (ids,) = bpe.encode_many([t])
        assert bpe.decode(ids) == t
        most = max(most, bpe.known)
    assert most < 200_000


def test_words_merged_side_by_side():
    """op2: as one by one and as the library does, whatever the words' lengths, and proposals are the longest tokens."""
    bpe, rng = model(PATH), random.Random(11)
    words = ["".join(rng.choice(x) for _ in range(n)) for n in (1, 2, 3, 7, 20, 48, 49, 200) for x in ("abcdefghiklmnorstuv", "ab", "e", "ÀéßñÜ", "漢字本語") for _ in range(40)]
    raws = [b"", *(w.encode() for w in words), *list(bpe.id_of)[::50]]
    assert bpe.merged_many(raws) == [bpe.merged(r) for r in raws] and bpe.merged_many([]) == []
    assert bpe.merged_many([w.encode() for w in words]) == [x.ids for x in library().encode_batch(words, add_special_tokens=False)]
    for r in raws:
        at = 0
        for i in bpe.proposed(r):
            assert max((e for e in range(at + 1, len(r) + 1) if r[at:e] in bpe.sound)) == at + len(bpe.bytes_of[i])
            at += len(bpe.bytes_of[i])
        assert at == len(r)


def test_frequent_words_are_encoded_once(monkeypatch):
    """op2: when the memory of words is full, those that came often stay."""
    from lorekeep.llm import bpe as B

    monkeypatch.setattr(B, "REMEMBERED", 1000)
    bpe, lib, learnt = SpeculativeBPE(PATH), library(), []
    learn = bpe.learn
    monkeypatch.setattr(bpe, "learn", lambda words: (learnt.extend(words), learn(words))[1])
    often = " ".join(f"often{i}" for i in range(200))
    for at in range(0, 9000, 900):
        text = f"{often} {often} " + " ".join(f"z{chr(97 + i % 26)}q{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(at, at + 900))
        assert bpe.encode_many([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids and bpe.known < 3000
    assert learnt.count(" often") == 1
