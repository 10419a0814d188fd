"""URL filter, quality rules, media, packing and token counts against plain readings."""

import array
import hashlib
import math
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from marlstone.llm import jpeg, media, packing, quality, urls, wordpieces

DOCS = "doc_id long, text string, n_bytes string, kept string"
ODD = [None, "", " \n\t", "one", "Ä ö\x0bß\x0c", "a b " * 20000, "\x1c\x85 \u3000x", "<|endoftext|> end", "  two  spaces\n\n and lines \n x"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)] + [(None, "null id", None, None), (0, texts[0], "x", None)], DOCS).repartition(3)


def prose(n, seed=0):
    draw = random.Random(seed)
    return [" ".join(draw.choice(["the", "Hain", "größe,", "ed.", "it's", "42", "a\nb", "z#z"]) for _ in range(draw.randint(0, 300))) for _ in range(n)]


def test_urls(spark):
    cases = {
        "http://a.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "HTTP://Example.ORG/en/12?x": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/ES/1": ("example.org", "/ES/1", "org/", "allow"),
        "https://notexample.org": ("notexample.org", "", None, "allow"),
        "x://shop.com/fr/casino-win": ("shop.com", "/fr/casino-win", "com/fr/", "allow"),
        "http://com/de/": ("com", "/de/", "com/de/", "block"),
        "http://telecom/de/": ("telecom", "/de/", None, "allow"),
        "http://cheap-pills.net/a": ("cheap-pills.net", "/a", None, "block"),
        "http://cheap-pillsy.net/a": ("cheap-pillsy.net", "/a", None, "allow"),
        "http://x.net/free/poker#a": ("x.net", "/free/poker", None, "block"),
        "http://x.net/free/free": ("x.net", "/free/free", None, "allow"),
        "http://x.net/freedom/betx": ("x.net", "/freedom/betx", None, "allow"),
        "http://x.net?a://b/c": ("x.net", "", None, "allow"),
        "no scheme/xxx": ("", "", None, "block"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(cases)] + [(None, "http://a.org/", None, None)] * 2, "page_id long, url string, host string, rule string")
    found = {r.page_id: tuple(r)[1:] for r in urls.judge(df).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge(df).count() == len(cases) + 2 and urls.judge(df.limit(0)).count() == 0


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def test_statistics():
    for t in [*ODD[:5], *ODD[6:], *prose(40), "a b c a b c a b", "x y\n\nx y\n \nx y"]:
        assert quality.statistics(t)[:5] == plain_statistics(t)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    judged = quality.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_quality_edges(spark):
    clean = [f"{' '.join(f'word{i * 7 + j}' for j in range(60 + i % 9))}." for i in range(80)]
    junk = [f"{' '.join(f'W{i * 7 + j}##**' for j in range(60))}" for i in range(20)]
    df = documents(spark, [*clean, *junk, *ODD])
    labels = spark.createDataFrame([(i, int(i < 80), None) for i in range(100)] + [(None, 1, None), (3, None, None), (4, 1, None), (9999, 0, None)], "doc_id long, quality int, text string")
    rows = quality.judge(df, labels).collect()
    assert len(rows) == 100 + len(ODD) + 2
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in rows if r.kept}
    assert len(kept & set(range(80))) >= 78 and not kept & set(range(80, 100))
    stay = quality.filter_documents(df, labels)
    assert stay.columns == df.columns and {r.doc_id for r in stay.collect()} == kept
    none = quality.judge(df, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality.judge(df.limit(0), labels).count() == 0


def test_media_round_trip(spark):
    texts = [*ODD, *prose(30), "ÿ" * 500, "x" * 192, "x" * 193]
    stored = media.store(documents(spark, texts)).collect()
    found = {r.doc_id: r for r in media.media_features(documents(spark, texts)).collect()}
    for r in stored:
        raw = ("null id" if r.doc_id is None else texts[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert r.n_bytes == len(raw) and jpeg.payload(jpeg.decode([bytes(r.media)])[0]) == payload
        f = found[r.doc_id]
        assert (f.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (f.media_bytes, f.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert media.media_features(documents(spark, texts).limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert [tuple(r) for r in media.features(nothing).collect()] == [(1, None, None, None, None, None, None)]


def plain_grey(payload):
    """One sample for each MCU: the DC of its first block, which is the first of its 192 bytes; spaces fill the rectangle."""
    n = len(payload) // 192
    columns = math.ceil(math.sqrt(n))
    rows = -(-n // columns)
    first = [payload[192 * i] if i < n else 32 for i in range(rows * columns)]
    grey = [min(255, max(0, ((v if v >= 128 else v - 255) + 4) // 8 + 128)) for v in first]
    return [grey[r * columns : (r + 1) * columns] for r in range(rows)]


def plain_hash(grey):
    """Whether a cell of an 8 x 9 grid is lighter than its left neighbour."""

    def spans(parts, size):
        return [(lo := k * size // parts, max(-(-((k + 1) * size) // parts), lo + 1)) for k in range(parts)]

    bits = ""
    for a, b in spans(8, len(grey)):
        cells = [Fraction(sum(sum(row[c:d]) for row in grey[a:b]), (b - a) * (d - c)) for c, d in spans(9, len(grey[0]))]
        bits += "".join("1" if y > x else "0" for x, y in zip(cells, cells[1:]))
    return f"{int(bits, 2):016x}"


def test_thumbnails(spark):
    texts = [*prose(12, 5), "x" * 5000, "Ä" * 9000, None, "".join(chr(33 + i * i % 90) for i in range(20_000))]
    for r in media.media_features(documents(spark, texts)).collect():
        raw = ("null id" if r.doc_id is None else texts[r.doc_id] or "").encode()
        grey = plain_grey(raw + b" " * (r.payload_bytes - len(raw)))
        assert r.feature == f"{len(grey[0]) * 8}x{len(grey) * 8} dhash={plain_hash(grey)}"


def test_long_files_in_slices_are_the_same(monkeypatch):
    draw = np.random.default_rng(5)
    payloads = [draw.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 7, 300, 1000)]
    whole = jpeg.store(payloads)
    monkeypatch.setattr(jpeg, "SLICE", 64)
    monkeypatch.setattr(jpeg, "PIECE", 5000)
    assert jpeg.store(payloads) == whole
    assert [jpeg.payload(i) for i in jpeg.decode(whole)] == payloads
    with pytest.raises(ValueError):
        jpeg.decode([whole[3][: len(whole[3]) // 2] + b"\xff\xd9"])


def test_memory_of_a_long_text():
    import tracemalloc

    raw = b"some words and more \xff" * 500_000
    tracemalloc.start()
    file = jpeg.store([media.padded(raw)])[0]
    stored = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    assert jpeg.payload(jpeg.decode([file])[0])[: len(raw)] == raw
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert stored < 6 * len(raw) + (1 << 26) and read < 9 * len(raw) + (1 << 27)


def plain_jpeg(coefficients, interval):
    """A 4:2:0 file of two MCU rows with runs of zeros, by the standard's own words: (bytes, MCUs of six blocks)."""
    dc, ac = {s: (5, s) for s in range(12)}, {}
    symbols = sorted({0x00, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 11)})
    for i, s in enumerate(symbols):
        ac[s] = (8, i)
    bits, out, previous = "", b"", [0, 0, 0]

    def value(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for m, mcu in enumerate(coefficients):
        if interval and m and m % interval == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            bits, previous = "", [0, 0, 0]
        for block, component in zip(mcu, (0, 0, 0, 0, 1, 2)):
            size, extra = value(int(block[0]) - previous[component])
            previous[component] = int(block[0])
            bits += format(dc[size][1], "05b") + extra
            run = 0
            for v in block[1:]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += format(ac[0xF0][1], "08b")
                    run -= 16
                size, extra = value(int(v))
                bits += format(ac[run << 4 | size][1], "08b") + extra
                run = 0
            if run:
                bits += format(ac[0x00][1], "08b")
    out += flush(bits)
    seg = lambda k, b: struct.pack(">BBH", 0xFF, k, len(b) + 2) + b
    head = b"\xff\xd8" + seg(0xDB, bytes([0, *[2] * 64])) + seg(0xC0, struct.pack(">BHHB", 8, 30, 40, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += seg(0xC4, bytes([0x00, 0, 0, 0, 0, 12, *[0] * 11, *range(12)])) + seg(0xC4, bytes([0x10, *[0] * 7, len(symbols), *[0] * 8, *symbols]))
    return head + (seg(0xDD, struct.pack(">H", interval)) if interval else b"") + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize("interval", [0, 1, 4])
def test_decodes_other_baseline_files(interval):
    draw = np.random.default_rng(interval)
    files, wanted = [], []
    for _ in range(3):
        x = draw.integers(-300, 300, (6, 6, 64)) * (draw.random((6, 6, 64)) < 0.2)
        x[2, 3] = 0
        files.append(plain_jpeg(x, interval))
        wanted.append(x)
    for image, x in zip(jpeg.decode(files), wanted):
        assert (image.width, image.height) == (40, 30)
        y, cb, cr = (c.coefficients for c in image.components)
        for m in range(6):
            row, column = divmod(m, 3)
            assert (y[2 * row : 2 * row + 2, 2 * column : 2 * column + 2].reshape(4, 64) == x[m, :4]).all()
            assert (cb[row, column] == x[m, 4]).all() and (cr[row, column] == x[m, 5]).all()
        assert (image.luminance() == np.clip((y[:, :, 0] * 2 + 4) // 8 + 128, 0, 255)).all()
    with pytest.raises(ValueError):
        jpeg.decode([files[0].replace(b"\xff\xc0", b"\xff\xc2", 1)])


def test_packing(spark):
    texts = [*ODD, *prose(30), "word " * 5000]
    rows = packing.pack(documents(spark, texts), with_ids=True).collect()
    whole = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")).whole
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and {r.offset for r in rows} == {0}
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True) and all(n <= 2048 and n & (n - 1) == 0 for n in lengths)
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))[:: 2 if i == 0 else 1]
        assert sum((r.ids for r in own), []) == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == [sum(r.length for r in own[:k]) for k in range(len(own))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(array.array("I", r.ids).tobytes()) for r in own]
    assert packing.pack(documents(spark, texts).limit(0)).count() == 0


def test_ids_are_the_librarys():
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    draw = random.Random(7)
    parts = ["a", " ", "  ", "\n", " \n", "é", "'s", "1", "!", "\u00a0", "\u3000", "\t", "<|endoftext|>", "B", "中", "\x1c", "😀", "don't"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
        assert encoder.ids(text) == array.array("I", encoder.whole.encode(text, add_special_tokens=False).ids).tobytes()


def test_word_pieces(spark):
    pieces = wordpieces.vocabulary()
    known, most = set(pieces), max(map(len, pieces))

    def greedy(word):
        n = 0
        while word:
            word = word[next(k for k in range(min(most, len(word)), 0, -1) if word[:k] in known) :]
            n += 1
        return n

    texts = [*ODD, *prose(30)]
    draw = random.Random(3)
    texts += ["".join(draw.choice("abcdeingthr.-é") for _ in range(draw.randint(1, 30))) for _ in range(300)]
    found = {r.doc_id: (r.n_words, r.n_pieces) for r in wordpieces.count(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert found[i] == (len(words), sum(greedy(b" " + w) for w in words))
    assert wordpieces.count(documents(spark, texts).limit(0)).count() == 0
    small = wordpieces.Automaton([bytes([c]) for c in range(256)] + [b"ab", b"abcd", b"bce", b"bc"])
    assert [small.run(w) for w in (b"abce", b"abcd", b"abc", b"bce", b"")] == [3, 1, 2, 1, 0]
