import hashlib
import random
import zlib

import numpy as np
import pytest

from spanlight.llm import media, webp
from spanlight.llm.queries import QUERIES


def bits_of(argb, out, outer, cache_bits=0, copies=(), groups=None, width=1):
    """Writes an image with normal codes: literals, copies {place: (length, distance code)} and cache hits where they fit."""
    out.write(1 if cache_bits else 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    if outer:
        out.write(0 if groups is None else 1, 1)
        if groups is not None:
            block, ids, across = groups
            out.write(block - 2, 3)
            bits_of([int(g) << 8 for g in ids], out, False, width=across)
    n_groups = 1 if groups is None else max(groups[1]) + 1
    hits = 1 << cache_bits if cache_bits else 0
    tables = []
    for _ in range(n_groups):
        own = []
        for n in (256 + 24 + hits, 256, 256, 256, 40):
            wide = (n - 1).bit_length()
            short = (1 << wide) - n
            lengths = np.array([wide - 1] * short + [wide] * (n - short))
            own.append((webp.write_code(out, lengths).tolist(), lengths.tolist()))
        tables.append(own)

    def symbol(table, s):
        out.write(table[0][s], table[1][s])

    def extended(value):
        value -= 1
        if value < 4:
            return value, 0, 0
        top = value.bit_length() - 1
        second = value >> top - 1 & 1
        return 2 * top + second, value & (1 << top - 1) - 1, top - 1

    cache, i = [None] * hits, 0
    used = {"copy": 0, "cache": 0}
    while i < len(argb):
        own = tables[0 if groups is None else groups[1][(i // width >> groups[0]) * groups[2] + (i % width >> groups[0])]]
        if i in copies:
            length, code, d = copies[i]
            assert all(argb[i + k] == argb[i + k - d] for k in range(length))
            p, extra, n = extended(length)
            symbol(own[0], 256 + p)
            out.write(extra, n)
            p, extra, n = extended(code)
            symbol(own[4], p)
            out.write(extra, n)
            used["copy"] += 1
            step = length
        else:
            v = argb[i]
            slot = webp.CACHE_FACTOR * v % (1 << 32) >> 32 - cache_bits if cache_bits else 0
            if cache_bits and cache[slot] == v:
                symbol(own[0], 280 + slot)
                used["cache"] += 1
            else:
                symbol(own[0], v >> 8 & 255)
                symbol(own[1], v >> 16 & 255)
                symbol(own[2], v & 255)
                symbol(own[3], v >> 24)
            step = 1
        for k in range(i, i + step):
            if cache_bits:
                cache[webp.CACHE_FACTOR * argb[k] % (1 << 32) >> 32 - cache_bits] = argb[k]
        i += step
    return used


def file_of(width, height, body):
    out = webp.Writer()
    out.write(0x2F, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)
    out.write(0, 3)
    body(out)
    data = out.value.to_bytes(out.n + 7 >> 3, "little")
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + bytes(len(data) & 1)
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


def picture(width, height, seed, few=False):
    r = np.random.default_rng(seed)
    p = r.integers(0, 256, (height, width, 4))
    return p[:, :, :] if not few else r.choice(p.reshape(-1, 4)[:5], width * height).reshape(height, width, 4)


def argb_of(p):
    return [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for a, r, g, b in p.reshape(-1, 4)]


def test_literals_cache_copies_and_meta_codes():
    p = picture(24, 12, 1, few=True)
    p[5, 3:20] = p[4, 3:20]
    p[9, 10:] = p[9, 9]
    copies = {5 * 24 + 3: (17, 1, 24), 9 * 24 + 10: (14, 120 + 1, 1)}
    assert webp.NEAR[0] == (0, 1) and webp.NEAR[1] == (1, 0) and webp.NEAR[4] == (0, 2) and webp.NEAR[-1] == (8, 7) and len(webp.NEAR) == 120
    argb = argb_of(p)
    used = {}

    def body(out):
        out.write(0, 1)
        used.update(bits_of(argb, out, True, cache_bits=4, copies=copies, groups=(2, [(i * 7) % 3 for i in range(18)], 6), width=24))

    got = webp.decode(file_of(24, 12, body))
    assert (got == p[..., [1, 2, 3, 0]]).all() and used["copy"] == 2 and used["cache"] > 50


def near(p, y, x):
    h, w, _ = p.shape
    left = p[y, x - 1]
    top, top_left = p[y - 1, x], p[y - 1, x - 1]
    right = p[y - 1, x + 1] if x + 1 < w else p[y, 0]
    return left, top, top_left, right


def half(a):
    return int(a / 2)


def guess(mode, L, T, TL, TR):
    avg = lambda a, b: (a + b) // 2
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        pl = sum(abs(int(t) - int(tl)) for t, tl in zip(T, TL))
        pt = sum(abs(int(a) - int(tl)) for a, tl in zip(L, TL))
        return L if pl < pt else T
    per = {
        0: None, 1: lambda l, t, tl, tr: l, 2: lambda l, t, tl, tr: t, 3: lambda l, t, tl, tr: tr, 4: lambda l, t, tl, tr: tl, 5: lambda l, t, tl, tr: avg(avg(l, tr), t), 6: lambda l, t, tl, tr: avg(l, tl),
        7: lambda l, t, tl, tr: avg(l, t), 8: lambda l, t, tl, tr: avg(tl, t), 9: lambda l, t, tl, tr: avg(t, tr), 10: lambda l, t, tl, tr: avg(avg(l, tl), avg(t, tr)), 12: lambda l, t, tl, tr: clamp(l + t - tl),
        13: lambda l, t, tl, tr: clamp(avg(l, t) + half(avg(l, t) - tl)),
    }[mode]
    return [255, 0, 0, 0] if mode == 0 else [per(*map(int, v)) for v in zip(L, T, TL, TR)]


@pytest.mark.parametrize("width, height", [(17, 9), (1, 5), (8, 1)])
def test_predictor_and_cross_colour_and_subtract_green(width, height):
    p = picture(width, height, 2).astype(int)
    across, down = (width + 3) // 4, (height + 3) // 4
    modes = [(i * 5 + 3) % 14 for i in range(across * down)]
    residual = np.zeros_like(p)
    for y in range(height):
        for x in range(width):
            if not y:
                g = p[0, x - 1] if x else [255, 0, 0, 0]
            elif not x:
                g = p[y - 1, 0]
            else:
                g = guess(modes[(y // 4) * across + x // 4], *near(p, y, x))
            residual[y, x] = (p[y, x] - g) & 255
    signed = lambda v: (int(v) + 128 & 255) - 128
    t = {"gr": 200, "gb": 37, "rb": 250}
    crossed = residual.copy()
    for y in range(height):
        for x in range(width):
            _, r, g, b = residual[y, x]
            crossed[y, x, 1] = (r - (signed(t["gr"]) * signed(g) >> 5)) & 255
            crossed[y, x, 3] = (b - (signed(t["gb"]) * signed(g) >> 5) - (signed(t["rb"]) * signed(r) >> 5)) & 255
    final = crossed.copy()
    final[..., 1] = (crossed[..., 1] - crossed[..., 2]) & 255
    final[..., 3] = (crossed[..., 3] - crossed[..., 2]) & 255

    def body(out):
        out.write(1, 1)
        out.write(0, 2)
        out.write(0, 3)
        bits_of([m << 8 for m in modes], out, False)
        out.write(1, 1)
        out.write(1, 2)
        out.write(0, 3)
        bits_of([255 << 24 | t["rb"] << 16 | t["gb"] << 8 | t["gr"]] * (across * down), out, False)
        out.write(1, 1)
        out.write(2, 2)
        out.write(0, 1)
        bits_of(argb_of(final), out, True)

    assert (webp.decode(file_of(width, height, body)) == p[..., [1, 2, 3, 0]]).all()


@pytest.mark.parametrize("colours, rows", [(1, 1), (2, 3), (3, 2), (9, 4), (17, 3), (90, 40), (256, 5)])
def test_round_trip_of_samples(colours, rows):
    r = np.random.default_rng(colours)
    s = r.choice(r.choice(256, colours, replace=False), rows * 192).astype(np.uint8)
    got = webp.decode(webp.encode(s))
    assert got.shape == (rows, 192, 4) and (got[..., 1].ravel() == s).all() and (got[..., 3] == 255).all()


def test_skewed_counts_stay_under_the_limit_and_many_images(monkeypatch):
    s = np.repeat(np.arange(25, dtype=np.uint8), [2**i for i in range(25)])[: 192 * 8000]
    s = np.concatenate([s, np.full(-len(s) % 192, 7, np.uint8)])
    monkeypatch.setattr(webp, "MOST_ROWS", 3000)
    images = webp.decode_all(webp.encode_all(s))
    assert len(images) == 3 and (np.concatenate([i[..., 1].ravel() for i in images]) == s).all()


def test_broken_files(spark):
    good = webp.encode(np.arange(192, dtype=np.uint8))
    rows = [(1, good), (2, good[:40]), (3, b"junk"), (4, None), (5, b"")]
    got = {r["id"]: r for r in media.pixels(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert got[1]["width"] == 192 and bytes(got[1]["rgba"])[1::4] == bytes(range(192))
    assert all(got[i]["rgba"] is None for i in (2, 3, 4, 5))


def test_query_over_odd_texts(spark, tmp_path):
    texts = ["", None, "é" * 500, "plain " * 100, "x", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op6_lossless_webp"](spark, str(tmp_path)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
