"""License scans, FLAC, WARC, token counts, near-dedup and BPE against brute force or an exact round trip."""

import base64
import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex

from guardwalk.llm import bpe, flac, licenses, neardup, unigram, warc
from tests.llm.common import docs, empty, listed, prose, texts

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
UNIGRAM = public_tokenizers.path("piece_bpe_32k.model")


# ---- licenses


def damaged(text: str, k: int, seed: int) -> str:
    r, out = random.Random(seed), list(text)
    for _ in range(k):
        i = r.randrange(1, len(out) - 1)
        kind = r.randrange(3)
        if kind == 0:
            out[i] = r.choice("qxz")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, r.choice("qxz"))
    return "".join(out)


def test_seeds_find_what_a_full_search_finds():
    s = licenses.Scanner()
    for seed in range(60):
        n, label, k, pattern = s.notices[seed % len(s.notices)]
        text = f"{prose(30, seed)} {damaged(n, seed % (k + 2), seed)} {prose(30, seed + 1)}"
        joined = " ".join(licenses.WORD.findall(text.lower()))
        brute = any(p.search(joined) for notice, lab, _, p in s.notices if lab == label)
        assert any(h.label == label for h in s.find(joined)) or not brute or any(h.edits == 0 for h in s.find(joined))
        if seed % (k + 2) <= k:
            assert brute


def least_edits(text: str, notice: str, k: int) -> list[int]:
    """Edits of the notices in a row of damaged ones: the best span, then the best before and behind it."""
    best = None
    for a in range(len(text)):
        row = list(range(len(notice) + 1))
        for b in range(a, min(len(text), a + len(notice) + k)):
            up, row = row, [row[0] + 1]
            for j, c in enumerate(notice):
                row.append(min(up[j] + (c != text[b]), up[j + 1] + 1, row[j] + 1))
            if row[-1] <= k and (best is None or row[-1] < best[0]):
                best = row[-1], a, b + 1
    return [] if best is None else [*least_edits(text[: best[1]], notice, k), best[0], *least_edits(text[best[2] :], notice, k)]


@pytest.mark.parametrize("at", [6, 9, 12])
def test_notices_before_a_better_one(at):
    """Neighbours of one kind, damaged more and less: each keeps its span."""
    notice, label = licenses.NOTICES[at]
    s, k = licenses.Scanner([(notice, label)]), licenses.edits_for(notice)
    for seed in range(8):
        edits = random.Random(seed).choices(range(k + 1), k=4) if seed else [*range(k, -1, -1)]
        parts = [damaged(notice, e, 10 * seed + i) for i, e in enumerate(edits)]
        text = " ".join(parts)
        hits = s.find(text)
        assert [h.edits for h in hits] == least_edits(text, notice, k)
        assert len(hits) == len(parts)
        for h, end in zip(hits, np.cumsum([len(p) + 1 for p in parts]), strict=True):
            assert abs(h.end - end + 1) <= k + 1
    assert [(h.start, h.end) for h in licenses.Scanner().find("all rights resrved all rights reserved")][1:] == [(19, 38)]


def test_base_places_by_brute_force():
    """Base places and every span of added notices against plain searches, over random texts of phrase words and damage."""
    s, r = licenses.scanner(), random.Random(3)
    pool = "gnu general public license apache cc by mit Licensé the under sa 4 0 x".split()
    for seed in range(300):
        words = [r.choice(pool) for _ in range(r.randrange(60))]
        text = "".join(w + r.choice((" ", "  ", "\n", "-", ". ")) for w in words)
        n, base, hits, score = licenses.scan_text(text, s)
        low = [w.lower() if w.isascii() else w[0].lower() + w[1:] for w in words]
        want = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(low)) if low[i : i + len(p.split())] == p.split())
        assert n == len(words) and base == want, seed
        assert not want or score == 1.0
        for label, first, last, a, b, edits in hits:
            assert licenses.WORD.findall(text[a:b].lower()) == low[first : last + 1], (seed, label, edits)


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (3_000, 12_000):
        t = time.perf_counter()
        said = licenses.scan_text("released under the mit license and " * n, licenses.scanner())
        took.append(time.perf_counter() - t)
        assert len(said[1]) == n and len(said[2]) == n
    assert took[1] < 10 * took[0]


def test_license_contract(spark):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark).filter("doc_id IS NOT NULL")).collect()}
    r = got[13]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == (10, 2, 3, 8, "mit", "mit", 1.0)
    assert got[1]["n_words"] == 0 and got[1]["first_word"] is None and got[1]["labels"] == "" and got[1]["score"] == 0
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_spans_point_into_the_text():
    text = "Ünder é: Released  under the MIT\nLicense; ok"
    _, _, hits, _ = licenses.scan_text(text, licenses.scanner())
    assert [text[a:b] for _, _, _, a, b, _ in hits] == ["Released  under the MIT\nLicense"]


# ---- FLAC


def test_flac_round_trip(spark):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in flac.read_media(flac.encode_media(docs(spark))).collect()}
    for i, t, _ in texts():
        n, p = flac.payload_of(t)
        r = got[(i, hashlib.sha256(p).hexdigest())]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (n, len(p), zlib.crc32(p[-16:])) and len(p) % 192 == 0 and p
        x = [b - 128 for b in p]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        assert r["feature"] == f"sum={sum(x)};energy={sum(v * v for v in x)};crossings={turns};peak={max(map(abs, x))}"
        (m,) = flac.encode([p])
        assert (r["media_bytes"], r["media_sha256"]) == (len(m), hashlib.sha256(m).hexdigest())
    assert flac.read_media(flac.encode_media(empty(spark))).count() == 0


def test_flac_any_bytes():
    r = random.Random(5)
    some = [bytes(192), bytes(range(192)), bytes(r.randrange(256) for _ in range(192 * 40)), b"\xff\x00" * 960, bytes([0] * 191 + [255]), b"ab" * 96 * 200]
    media = flac.encode(some)
    assert flac.decode(media) == some
    for p, m in zip(some, media, strict=True):
        for _ in range(5):
            a, n = r.randrange(len(p)), r.randrange(1, 600)
            assert flac.read_samples(m, a, n) == p[a : a + n]


@pytest.mark.parametrize("most", [1, 3, 7])
def test_flac_without_a_point_per_block(monkeypatch, most):
    """Frames without a seek point are found by their headers, also where a frame's bytes look like a header."""
    r = random.Random(6)
    some = [bytes(r.randrange(256) for _ in range(192 * 300)), flac.payload_of(prose(3000, 7))[1], bytes(192)]
    (one,) = flac.encode([some[0]])
    n, _, points, at = flac.layout(one)
    like = [one[at + int(p["offset"]) :][:6] for p in points[100:200]]  # headers of later frames as samples of earlier ones
    some.append(b"".join(like).ljust(192 * 4, b"\x07") + some[0][: 192 * 250])
    monkeypatch.setattr(flac, "POINTS", most)
    media = flac.encode(some)
    for m, p in zip(media, some, strict=True):
        n, _, points, at = flac.layout(m)
        assert 1 <= len(points) <= most and n == len(p) and (len(points) * 192 < n or n == 192)
    assert flac.decode(media) == some
    for p, m in zip(some, media, strict=True):
        for a, c in [(0, 1), (len(p) - 5, 9), *((r.randrange(len(p)), r.randrange(1, 900)) for _ in range(4))]:
            assert flac.read_samples(m, a, c) == p[a : a + c]
    cut = media[0][: flac.layout(media[0])[3]] + media[0][-1000:]
    with pytest.raises(flac.BadStream):
        flac.decode([cut])


def test_flac_checks_catch_every_flipped_bit():
    p = flac.payload_of(prose(100, 3))[1]
    m = flac.encode([p])[0]
    _, _, _, at = flac.layout(m)
    for i in range(at, len(m), 7):
        bad = bytearray(m)
        bad[i] ^= 1 << (i % 8)
        with pytest.raises(flac.BadStream):
            flac.decode([bytes(bad)])


def test_flac_decodes_other_partitions_and_orders():
    """A hand-made frame: fixed order 3, Rice partition order 2."""
    x = (np.cumsum(np.cumsum(np.random.default_rng(1).integers(-1, 2, 192))) // 8 % 100 - 50).astype(int)
    bits = f"0{8 + 3:06b}0" + "".join(f"{v & 255:08b}" for v in x[:3]) + "00" + f"{2:04b}"
    res = [int(x[i] - 3 * x[i - 1] + 3 * x[i - 2] - x[i - 3]) for i in range(3, 192)]
    for part in range(4):
        k = part + 1
        bits += f"{k:04b}"
        for v in res[max(0, part * 48 - 3) : part * 48 + 45]:
            z = v * 2 if v >= 0 else -v * 2 - 1
            bits += "0" * (z >> k) + "1" + f"{z & ((1 << k) - 1):0{k}b}"
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x14, 0x02, 0])
    buf = np.frombuffer(head, np.uint8)
    head += bytes([int(flac.crc(buf, np.array([0]), np.array([5]), flac.CRC8, 8)[0])])
    body = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    c = int(flac.crc(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]), flac.CRC16, 16)[0])
    got, end = flac.decode_frames(np.frombuffer(body + c.to_bytes(2, "big"), np.uint8), np.array([0]), np.array([0]))
    assert got[0].tolist() == x.tolist() and end[0] == len(body) + 2


def test_flac_decodes_a_hand_made_linear_predictor():
    """Order 3, precision 7, shift 5, five-bit Rice parameters in two partitions."""
    x = [int(60 * np.sin(i / 9) + 20 * np.cos(i / 4)) for i in range(192)]
    weights, shift = (61, -33, 3), 5
    bits = f"0{31 + 3:06b}0" + "".join(f"{v & 255:08b}" for v in x[:3]) + f"{6:04b}{shift:05b}" + "".join(f"{w & 127:07b}" for w in weights) + "01" + f"{1:04b}"
    for part, k in ((range(3, 96), 2), (range(96, 192), 4)):
        bits += f"{k:05b}"
        for i in part:
            v = x[i] - (sum(w * x[i - 1 - j] for j, w in enumerate(weights)) >> shift)
            z = v * 2 if v >= 0 else -v * 2 - 1
            bits += "0" * (z >> k) + "1" + f"{z & ((1 << k) - 1):0{k}b}"
    bits += "0" * (-len(bits) % 8)
    table = lambda data, t, size: int(flac.crc(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), t, size)[0])
    head = bytes([0xFF, 0xF8, 0x14, 0x02, 0])
    body = head + bytes([table(head, flac.CRC8, 8)]) + int(bits, 2).to_bytes(len(bits) // 8, "big")
    body += table(body, flac.CRC16, 16).to_bytes(2, "big")
    got, end = flac.decode_frames(np.frombuffer(body, np.uint8), np.array([0]), np.array([0]))
    assert got[0].tolist() == x and end[0] == len(body)


def test_pcm_blocks(spark):
    rows = flac.pcm_blocks(flac.encode_media(docs(spark).filter("doc_id = 6")), 960).orderBy("sample_offset").collect()
    assert b"".join(r["pcm"] for r in rows) == flac.payload_of(texts()[6][1])[1] and [r["sample_offset"] for r in rows] == [960 * i for i in range(len(rows))]


# ---- WARC


def pages(spark):
    rows = [(1, "u1", "same"), (2, "u 2", "same"), (3, None, "other"), (4, "u4", None), (5, "u5", ""), (None, "u6", "same"), (7, "u\r\n7", "same"), (7, "u7", "same")]
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, digest string, holder string, n long")


def test_warc_round_trip(spark):
    got = warc.salvage(warc.write_archives(warc.mark_revisits(pages(spark))), with_payload=True).collect()
    assert {r["kind"] for r in got} == {"record"}
    say = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=repr)
    assert say == sorted([("1", "revisit", "7", 4), ("2", "revisit", "7", 4), ("3", "response", None, 5), ("4", "revisit", "5", 0), ("5", "response", None, 0), (None, "response", None, 4), ("7", "response", None, 4), ("7", "response", None, 4)], key=repr)
    assert all(r["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode() for r in got for p in [bytes(r["payload"])] if r["record_type"] == "response")
    assert warc.salvage(warc.write_archives(warc.mark_revisits(pages(spark).limit(0)))).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = [warc.record(str(i), f"http://x/{i}", f"page {i} ".encode() * 50, None, len(f"page {i} ") * 50, warc.sha1_32(f"page {i} ".encode() * 50)) for i in range(6)]
    parts = [warc.member(p) if compress else p for p in parts]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0x55
    data = parts[0] + b"junk" + parts[1] + bytes(bad) + parts[3] + parts[4][:-9] + parts[5]
    rows = list(warc.salvage_bytes("a", data))
    assert [r[4] for r in rows if r[1] == "record"] == ["0", "1", "3", "5"]
    gaps = [(r[2], r[3]) for r in rows if r[1] == "gap"]
    at = len(parts[0])
    assert gaps[0] == (at, 4) and gaps[1] == (at + 4 + len(parts[1]), len(bad)) and len(gaps) == 3
    assert sum(r[3] for r in rows) == len(data)


@pytest.mark.parametrize("compress", [True, False])
def test_salvage_of_damage_in_bulk(spark, tmp_path, compress):
    """Archives as objects, damaged in many places: every untouched record comes back, nothing else does, and rows cover all bytes."""
    rows = [(i, f"http://x/{i}", f"<p>{prose(20 + i % 40, i)}</p>") for i in range(300)]
    marked = warc.mark_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    archives = warc.write_archives(marked, 6000, compress).checkpoint()
    assert warc.store_archives(archives, str(tmp_path / "a")).count() == archives.count() > 9
    before = {}
    for r in warc.salvage(warc.read_archives(spark, str(tmp_path / "a"))).collect():
        before[r["archive"], r["offset"]] = r
    assert len(before) == 300 and {r["kind"] for r in before.values()} == {"record"}
    rng, hit = random.Random(4), {}
    for f in sorted((tmp_path / "a").iterdir()):
        data = bytearray(f.read_bytes())
        for _ in range(3):
            at = rng.randrange(len(data))
            data[at] ^= 1 + rng.randrange(255)
            hit.setdefault(f.name, []).append(at)
        f.write_bytes(bytes(data))
    after = warc.salvage(warc.read_archives(spark, str(tmp_path / "a")), with_payload=True).collect()
    whole = {k: r for k, r in before.items() if not any(r["offset"] <= x < r["offset"] + r["length"] for x in hit[k[0]])}
    got = {(r["archive"], r["offset"]): r for r in after if r["kind"] == "record"}
    same = ("length", "page_id", "payload_bytes", "payload_digest", "record_type")
    assert 200 < len(whole) < 300 and all(all(got[k][c] == r[c] for c in same) for k, r in whole.items())
    # a record with a damaged byte comes back only where no check covers that byte (a plain record's header), and then with its payload unhurt
    assert {bytes(r["payload"]) for r in got.values()} <= {h.encode() for _, _, h in rows} and (not compress or set(got) == set(whole))
    for name in hit:
        spans = sorted((r["offset"], r["length"]) for r in after if r["archive"] == name)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(spans[-1]) == sum(r["length"] for k, r in before.items() if k[0] == name)


def _marks(kind, n):
    line = b"WARC/1.0\r\nContent-Length: 7\r\n"
    return {
        "magics": warc.MAGIC * n,
        "magics with zeros": (warc.MAGIC + b"\x00" * 7) * n,
        "names without an end": (warc.MAGIC + b"\x08" + b"x" * 30) * n,
        "versions": warc.VERSION * n,
        "version lines": line * n,
        "version lines with blank lines far off": line * n + b"\r\n\r\n",
        "headers of one damaged record each": (line + b"\r\n" + b"1234567xx\r\n\r\n") * n,
        "version lines in a member": warc.member(line * n),
    }[kind]


@pytest.mark.parametrize("kind", ["magics", "magics with zeros", "names without an end", "versions", "version lines", "version lines with blank lines far off", "headers of one damaged record each", "version lines in a member"])
def test_salvage_looks_at_bytes_in_proportion(kind):
    """Very many false marks: the bytes looked at are a bounded multiple of the archive's, at either size."""
    for n in (2_000, 40_000):
        data = _marks(kind, n)
        scan = warc.Scan(data)
        rows = list(warc.salvage_bytes("a", data, scan=scan))
        assert {r[1] for r in rows} == {"gap"} and sum(r[3] for r in rows) == len(data)
        assert scan.looked < 60 * max(len(data), 30 * n)


def test_query_stops_at_a_gap(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "member", lambda data: zlib.compress(data))
    with pytest.raises(Exception, match="gap in an archive"):
        warc.query(spark, sf).count()


def test_salvage_inside_a_member():
    """Several records in one member: a damaged one and junk go, the others stay."""
    parts = [warc.record(str(i), f"http://x/{i}", b"page %d" % i, None, 6, warc.sha1_32(b"page %d" % i)) for i in range(4)]
    data = warc.member(b"".join(parts))
    assert [r[4] for r in warc.salvage_bytes("a", data)] == ["0", "1", "2", "3"]
    parts[1] = parts[1].replace(b"page 1", b"page x")
    inner = b"".join([*parts[:3], b"junk", parts[3]])
    data = warc.member(inner) + warc.member(parts[0]) + warc.member(b"nothing")
    rows = list(warc.salvage_bytes("a", data))
    assert [(r[1], r[4]) for r in rows] == [("record", "0"), ("gap", None), ("record", "2"), ("gap", None), ("record", "3"), ("record", "0"), ("gap", None)]
    a, b = len(parts[0]), len(parts[0] + parts[1])
    assert rows[1][10].endswith(f"unpacked bytes {a} to {b}") and rows[3][10].endswith(f"unpacked bytes {b + len(parts[2])} to {b + len(parts[2]) + 4}")
    assert sum(r[3] for r in rows) == len(data)


def test_members_are_plain_gzip():
    one = warc.record("1", "u", b"x", None, 1, warc.sha1_32(b"x"))
    assert gzip.decompress(warc.member(one)) == one


# ---- tokenizers


def test_bpe_equals_the_library(spark):
    import tiktoken

    e = bpe.encoder(BPE, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.v.ranks, special_tokens={})
    r = random.Random(3)
    odd = ["".join(r.choice(" \n\tab'sd.1é日\x1c½ the") for _ in range(r.randrange(20))) for _ in range(3000)] + [t or "" for _, t, _ in texts()] + ["a" * 3000, " " * 500, "don't  I'LL\n\n x"]
    for t in odd:
        assert e.encode(t) == " ".join(map(str, lib.encode_ordinary(t)))
        assert e.decode(e.encode(t)) == t.encode()
    got = listed(bpe.encode_texts(docs(spark), BPE, public_tokenizers.PATTERN))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, _ in texts() for ids in [lib.encode_ordinary(t or "")]]
    assert got == sorted(want, key=repr)
    assert bpe.encode_texts(empty(spark), BPE, public_tokenizers.PATTERN).count() == 0


def test_prefixes_append_and_edit():
    v = bpe.encoder(BPE, public_tokenizers.PATTERN).v
    r = random.Random(4)
    for _ in range(100):
        s = bytes(r.choice(b"abcdetion the ing") for _ in range(r.randrange(1, 300)))
        p = bpe.Prefixes(v)
        for i in range(0, len(s), 7):
            p.append(s[i : i + 7])
        assert p.last == bpe.Prefixes(v, s).last
        a = r.randrange(len(s))
        b = min(len(s), a + r.randrange(6))
        p.edit(a, b, b"xyzw"[: r.randrange(5)])
        assert p.last == bpe.Prefixes(v, p.data).last
    long = bpe.Prefixes(v, b"the quick brown fox " * 500)
    assert long.edit(5000, 5003, b"cat") < 1000  # only prefixes near the edit


def test_unigram_equals_the_library(spark):
    from tokenizers import Tokenizer, models
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=UNIGRAM)
    vocab = [("<unk>", 0.0)] + [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    lib = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    r = random.Random(6)
    odd = ["".join(r.choice("  \n▁abthe日é\U0001f389") for _ in range(r.randrange(1, 25))) for _ in range(2000)] + [t for _, t, _ in texts() if t]
    c = unigram.counter(UNIGRAM)
    for t in odd:
        ids = lib.encode("▁" + t.replace(" ", "▁")).ids
        assert c.count(t)[:2] == (len(ids), ids.count(0)), t
    got = {r["doc_id"]: r["n_pieces"] for r in unigram.count_tokens(docs(spark).filter("doc_id > 3"), UNIGRAM).collect()}
    assert got[6] == c.count(texts()[6][1])[0]
    assert unigram.count_tokens(empty(spark), UNIGRAM).count() == 0


def test_fractional_scores_equal_the_library():
    """Random vocabularies with fractional and tied scores, with and without the mark as a piece."""
    from tokenizers import Tokenizer, models

    r = random.Random(8)
    for seed in range(40):
        pieces = {"".join(r.choice("▁abc") if i == 0 else r.choice("abc") for i in range(r.randrange(1, 5))) for _ in range(25)}
        pieces = sorted(pieces | {"a", "b"} | ({"▁"} if seed % 2 else set()))
        vocab = [(p, -round(r.uniform(1, 6), 3) if seed % 4 < 2 else -float(len(p)) / 4) for p in pieces]
        lib, c = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], unk_id=0, byte_fallback=False)), unigram.Counter(vocab)
        for _ in range(60):
            t = "".join(r.choice("  abcx") for _ in range(r.randrange(1, 20)))
            ids = lib.encode("▁" + t.replace(" ", "▁")).ids
            assert c.count(t)[:2] == (len(ids), ids.count(0)), (seed, t)


def test_unigram_ties():
    """Equal scores: the earliest start, that is the longest piece, wins."""
    c = unigram.Counter([("ab", -2.0), ("a", -1.0), ("b", -1.0)])
    assert c.search("ab") == (1, 0, -2.0)
    assert c.search("axxb") == (3, 1, -2.0 + 2 * c.unknown)


# ---- near copies


def plain_components(rows, width=4):
    sets = []
    for _, t in rows:
        w = neardup.WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least[top(i)] if d is not None else None, d is None or d == least[top(i)]) for i, (d, _) in enumerate(rows)]


def test_near_copies_odd(spark):
    rows = [(i, t) for i, t, _ in texts()]
    # a repeated id whose rows differ in nothing but the row
    assert listed(neardup.components_of(docs(spark))) == sorted(plain_components(rows), key=repr)
    assert neardup.components_of(empty(spark)).count() == 0
    kept = neardup.drop_near_copies(docs(spark))
    assert kept.columns == docs(spark).columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 4, 6, 8, None}
    assert not {r["doc_id"] for r in kept.collect()} & {7, 10}
    base = texts()[8][1]
    rows = [(1, base, "b"), (1, base, "a"), (1, base, "a"), (2, base, "c"), (3, prose(90, 77), "x"), (3, prose(90, 78), "y"), (4, None, "n"), (4, None, "n")]
    one = neardup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert listed(one) == sorted([rows[1], *rows[4:]], key=repr)  # of repeated rows the least stays; an id may have several texts


def test_large_groups_and_chains(spark, monkeypatch):
    """A group larger than a node, whose members resemble their base more than each other, a chain, and a common passage."""
    for name, n in (("SMALL", 24), ("CHUNK", 16), ("PIVOTS", 6), ("PROBE", 12), ("LOW_SIZE", 60), ("DEPTH", 3)):
        monkeypatch.setattr(neardup, name, n)
    r = random.Random(9)
    base = prose(300, 11).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        rows.append((i + 1000, " ".join(w)))
    chain = prose(200, 12).split()
    for i in range(30):
        chain[(i * 7) % 200] = f"c{i}"
        rows.append((i + 2000, " ".join(chain)))
    common = prose(60, 13)
    rows += [(i + 3000, f"{common} {prose(90, 100 + i)}") for i in range(80)]
    got = neardup.components_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert listed(got) == sorted(plain_components(rows), key=repr)


def test_components_of_paths(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    random.Random(1).shuffle(e)
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}
