import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from dendrovox.llm import progressive_jpeg as jpeg
from dendrovox.llm import secrets, url_filters

DOCS = "doc_id long, text string, media string, feature string, spans string, source string"


def docs(spark, texts):
    return spark.createDataFrame([(i, x, "m", "f", "s", None) for i, x in enumerate(texts)], DOCS)


# ---- op1


@pytest.mark.parametrize("density", [0.003, 0.05, 0.5, 1.0])
def test_jpeg_coefficients_round_trip(density):
    rng = np.random.default_rng(3)
    images = []
    for mx, my in ((1, 1), (2, 3), (4, 2)):
        c = rng.integers(-700, 700, (6 * mx * my, 64)).astype(np.int32)
        c[rng.random(c.shape) > density] = 0
        c[:, 30:] //= 400
        images.append(jpeg.Image(mx, my, c))
    for got, want in zip(jpeg.read_images(jpeg.write_images(images)), images):
        assert (got.coefficients == want.coefficients).all()


def test_jpeg_streams_of_different_scripts_in_one_batch(monkeypatch):
    image = jpeg.payload_image(jpeg.payload_of("abc" * 500)[1])
    usual = jpeg.write_images([image])[0]
    monkeypatch.setattr(jpeg, "SCANS", (((0, 1, 2), 0, 0, 0, 0), *(((c,), 1, 63, 0, 0) for c in range(3))))
    monkeypatch.setattr(jpeg, "AC_TABLE", jpeg.Huffman.favouring(0x08))
    monkeypatch.setattr(jpeg, "RESTART_BLOCKS", 100)
    other = jpeg.write_images([image])[0]
    assert usual != other
    for x in jpeg.read_images([usual, other, usual]):
        assert (x.coefficients == image.coefficients).all()


def test_inverse_transform_and_colour():
    c = np.zeros((6, 64), np.int32)
    c[:4, 0] = 8 * 50
    c[5, 0] = 8 * 20
    rgb = jpeg.rgb_tensors([jpeg.Image(1, 1, c)])[0]
    assert rgb.shape == (16, 16, 3)
    y, cr = 178, 20
    assert rgb[0, 0].tolist() == [round(y + 1.402 * cr), round(y - 0.714136 * cr), y]
    c = np.random.default_rng(0).integers(-60, 60, (6, 64)).astype(np.int32)
    rgb = jpeg.rgb_tensors([jpeg.Image(1, 1, c)])[0].astype(int)
    n = np.arange(8)
    basis = np.cos((2 * n[None] + 1) * n[:, None] * np.pi / 16) * np.where(n == 0, 0.5**0.5, 1)[:, None] / 2
    grid = np.zeros((8, 8))
    grid.ravel()[jpeg.ZIGZAG] = c[0]
    sample = np.clip(np.rint(basis.T @ grid @ basis + 128), 0, 255)
    grey = 0.299 * rgb[:8, :8, 0] + 0.587 * rgb[:8, :8, 1] + 0.114 * rgb[:8, :8, 2]
    inside = (rgb[:8, :8] > 0).all(axis=2) & (rgb[:8, :8] < 255).all(axis=2)
    assert inside.any() and np.abs(grey - sample)[inside].max() < 2


class PlainWriter:
    """A progressive writer of its own, bit by bit: one table for DC, one for AC, no restarts."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]

    def dc(self, size):
        self.put(size, 4)

    def ac(self, symbol):
        self.put(*((symbol, 8) if symbol < 128 else (256 + symbol - 128, 9)))

    def number(self, v, size):
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def data(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")


def segment(marker, body):
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def plain_stream(width, height, sampling, blocks):
    """``blocks[c][row][column]``: 64 zigzag coefficients; DC and AC each in a first and a refining scan."""
    n, most_h, most_v = len(sampling), max(h for h, _ in sampling), max(v for _, v in sampling)
    out = b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes(range(1, 65)))
    out += segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([7 + c, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)))
    out += segment(0xC4, bytes([0x00]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + segment(0xC4, bytes([0x10]) + bytes([0] * 7 + [128, 128] + [0] * 7) + bytes(range(256)))

    def scan(components, first, last, high, low, w):
        head = bytes([len(components)]) + b"".join(bytes([7 + c, 0]) for c in components) + bytes([first, last, high << 4 | low])
        return segment(0xDA, head) + w.data()

    def units(c):
        if n == 1:
            return [b for row in blocks[0] for b in row]
        h, v = sampling[c]
        rows, columns = -(-(-(-height * v // most_v)) // 8), -(-(-(-width * h // most_h)) // 8)
        return [b for row in blocks[c][:rows] for b in row[:columns]]

    whole = []
    if n == 1:
        whole = [(0, b) for b in units(0)]
    else:
        for my in range(-(-height // (8 * most_v))):
            for mx in range(-(-width // (8 * most_h))):
                whole += [(c, blocks[c][my * v + y][mx * h + x]) for c, (h, v) in enumerate(sampling) for y in range(v) for x in range(h)]
    w, before = PlainWriter(), [0] * n
    for c, b in whole:
        v = b[0] >> 1
        size = abs(v - before[c]).bit_length()
        w.dc(size)
        w.number(v - before[c], size)
        before[c] = v
    out += scan(range(n), 0, 0, 0, 1, w)
    for c in range(n):
        w = PlainWriter()
        for b in units(c):
            run = 0
            for k in range(1, 64):
                v = (abs(b[k]) >> 1) * (1 if b[k] > 0 else -1)
                if not v:
                    run += 1
                    continue
                while run > 15:
                    w.ac(0xF0)
                    run -= 16
                size = abs(v).bit_length()
                w.ac(run << 4 | size)
                w.number(v, size)
                run = 0
            if run:
                w.ac(0)
        out += scan([c], 1, 63, 0, 1, w)
    w = PlainWriter()
    for _, b in whole:
        w.put(b[0] & 1, 1)
    out += scan(range(n), 0, 0, 1, 0, w)
    for c in range(n):
        w = PlainWriter()
        for b in units(c):
            run, held, last = 0, [], max((k for k in range(1, 64) if abs(b[k]) == 1), default=0)
            for k in range(1, 64):
                v = abs(b[k])
                if not v:
                    run += 1
                    continue
                while run > 15 and k <= last:
                    w.ac(0xF0)
                    w.bits += held
                    run, held = run - 16, []
                if v > 1:
                    held.append(v & 1)
                    continue
                w.ac(run << 4 | 1)
                w.bits += [int(b[k] > 0), *held]
                run, held = 0, []
            if run or held:
                w.ac(0)
                w.bits += held
        out += scan([c], 1, 63, 1, 0, w)
    return out + b"\xff\xd9"


def plain_image(width, height, sampling, seed):
    rng = np.random.default_rng(seed)
    most_h, most_v = max(h for h, _ in sampling), max(v for _, v in sampling)
    blocks = []
    for h, v in sampling:
        rows, columns = -(-height // (8 * most_v)) * v, -(-width // (8 * most_h)) * h
        c = rng.integers(-9, 10, (rows, columns, 64)) * (rng.random((rows, columns, 64)) < 0.15)
        c[..., 0] = rng.integers(-200, 200, (rows, columns))
        covered = -(-(-(-height * v // most_v)) // 8), -(-(-(-width * h // most_h)) // 8)
        c[covered[0] :, :, 1:] = 0
        c[:, covered[1] :, 1:] = 0
        blocks.append(c.tolist())
    return blocks


@pytest.mark.parametrize("width,height,sampling", [
    (24, 24, ((2, 2), (1, 1), (1, 1))), (32, 23, ((1, 1), (1, 1), (1, 1))), (33, 17, ((2, 1), (1, 1), (1, 1))), (17, 41, ((1, 2), (1, 1), (1, 1))), (640, 9, ((2, 2), (2, 1), (1, 1))), (13, 30, ((1, 1),)), (5, 5, ((2, 2),)),
])
def test_streams_of_another_writer(width, height, sampling):
    one = ((1, 1),) if len(sampling) == 1 else sampling
    blocks = plain_image(width, height, one, width)
    stream = plain_stream(width, height, one, blocks)
    if sampling == ((2, 2),):
        stream = stream.replace(bytes([1, 7, 0x11, 0]), bytes([1, 7, 0x22, 0]))
    image = jpeg.read_images([stream])[0]
    at = 0
    for c in blocks:
        flat = np.array(c).reshape(-1, 64)
        assert (image.coefficients[at : at + len(flat)] == flat).all()
        at += len(flat)
    rgb = jpeg.rgb_tensors([image])[0].astype(int)
    assert rgb.shape == (height, width, 3)
    n = np.arange(8)
    basis = np.cos((2 * n[None] + 1) * n[:, None] * np.pi / 16) * np.where(n == 0, 0.5**0.5, 1)[:, None] / 2
    most_h, most_v = max(h for h, _ in one), max(v for _, v in one)
    planes = []
    for (h, v), c in zip(one, blocks):
        rows = []
        for row in c:
            line = []
            for b in row:
                grid = np.zeros(64)
                grid[jpeg.ZIGZAG] = np.array(b) * np.arange(1, 65)
                line.append(np.clip(np.rint(basis.T @ grid.reshape(8, 8) @ basis + 128), 0, 255))
            rows.append(np.hstack(line))
        planes.append(np.kron(np.vstack(rows), np.ones((most_v // v, most_h // h)))[:height, :width])
    y, cb, cr = planes if len(planes) == 3 else (planes[0], 128, 128)
    want = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2)
    assert np.abs(rgb - np.clip(want, 0, 255)).max() <= 4


def test_samplings_of_a_batch_are_kept_apart():
    kinds = [((2, 2), (1, 1), (1, 1)), ((2, 1), (2, 1), (2, 1)), ((1, 1), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1)), ((1, 2), (1, 1), (1, 1)), ((1, 1),), ((2, 2), (2, 1), (1, 1))]
    streams = [plain_stream(35, 27, x, plain_image(35, 27, x, i)) for i, x in enumerate(kinds)]
    alone = [jpeg.read_images([x])[0].coefficients for x in streams]
    for i in range(len(kinds)):
        for k in range(len(kinds)):
            both = jpeg.read_images([streams[i], streams[k]])
            assert (both[0].coefficients == alone[i]).all() and (both[1].coefficients == alone[k]).all(), (kinds[i], kinds[k])
    assert all((x.coefficients == y).all() for x, y in zip(jpeg.read_images(streams), alone))


def test_a_bad_stream_is_a_row_with_a_problem(spark):
    good = plain_stream(24, 24, ((2, 2), (1, 1), (1, 1)), plain_image(24, 24, ((2, 2), (1, 1), (1, 1)), 1))
    grey = plain_stream(13, 30, ((1, 1),), plain_image(13, 30, ((1, 1),), 2))
    baseline, torn, broken = good.replace(b"\xff\xc2", b"\xff\xc0"), good[: len(good) // 2], bytearray(good)
    broken[len(good) * 2 // 3] ^= 0x55
    huge = good.replace((24).to_bytes(2, "big") * 2, b"\xff\xff\xff\xff", 1)
    media = [good, baseline, None, torn, grey, b"", b"no picture", huge, good]
    rows = jpeg.read_media(spark.createDataFrame(list(enumerate(media)), "k int, media binary").coalesce(1), with_tensor=True).collect()
    by = {r["k"]: r for r in rows}
    assert [by[k]["problem"] is None for k in range(9)] == [True, False, True, False, True, False, False, False, True]
    assert by[0]["feature"] == by[8]["feature"] and (by[4]["width"], by[4]["height"]) == (13, 30) and by[2]["feature"] is None
    assert all(by[k]["rgb"] is None for k in (1, 2, 3, 5, 6, 7)) and len(by[0]["rgb"]) == 24 * 24 * 3
    jpeg.decoded([bytes(broken), good])


def test_zigzag_is_the_formats():
    assert sorted(jpeg.ZIGZAG.tolist()) == list(range(64))
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]


def test_media_keep_whole_payloads(spark):
    texts = [None, "", "a", "x" * 63, "é" * 32, "y" * 64, "long " * 40_000, "a"]
    stored = jpeg.store_media(docs(spark, texts))
    rows = {r["doc_id"]: r for r in jpeg.digests(stored).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[2]["media_sha256"] == rows[7]["media_sha256"] and rows[2]["feature"] == rows[7]["feature"]
    assert rows[0]["feature"] == rows[1]["feature"] != rows[2]["feature"]
    tensor = jpeg.read_media(stored.where("doc_id = 5"), with_tensor=True).first()
    assert len(tensor["rgb"]) == tensor["height"] * tensor["width"] * 3
    assert jpeg.read_media(stored.selectExpr("doc_id", "cast(null as binary) as media")).first()["payload"] is None
    assert jpeg.digests(jpeg.store_media(docs(spark, []))).count() == 0


# ---- op7


def brute_base(text):
    assign = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.BASE_KINDS[k], a, b) for a, k, b in sorted(found)]


def test_base_patterns_match_brute_force(spark):
    random.seed(5)
    bits = ["password", "PASSWD", "secret=", "token: ", "api_key", "apikey='", "=", ":", " ", "AKIA", "ABCDEFGH1234", "deadbeef01", "é", "ſ", "K", "\n", "abc", "0123456789abcdef0123456789", "x" * 7]
    texts = [None, "", "secret=token: abcdefg", "token=token=abcdefgh", "ſecret=abcdefgh", "AKIA" + "A" * 16 + "b", *("".join(random.choices(bits, k=random.randint(1, 60))) for _ in range(200))]
    rows = secrets.scan_secrets(docs(spark, texts)).orderBy("doc_id").collect()
    assert len(rows) == len(texts) and rows[0]["source"] is None
    for text, r in zip(texts, rows):
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in secrets.BASE_KINDS] == brute_base(text or "")


def test_entropy_windows_match_brute_force():
    random.seed(1)
    run = "".join(random.choices("abcdefgh0123", k=90))
    for i, bits in enumerate(secrets.entropy_windows(run, 20)):
        part = run[i : i + 20]
        assert math.isclose(bits, -sum(part.count(c) / 20 * math.log2(part.count(c) / 20) for c in set(part)), abs_tol=1e-9)


def test_entropy_finds_and_allows():
    scan = secrets.Scanner()
    key = "zX9qLm3Vt7Kp2Rw8Yc5Nd1Hs"
    assert [s["kind"] for s in scan(f"see {key} there")] == ["entropy_base64"]
    assert scan("123e4567-e89b-12d3-a456-426614174000") == []
    assert scan("see zX9qLm3Vt7Kp2Rw8Yc5example there") == []
    assert scan("an ordinary sentence of averyveryveryverylongword and more") == []
    assert [s["kind"] for s in scan("0A1B2C3D4E5F60718293A4B5")] == ["entropy_hex"]


def test_a_key_beside_an_allowed_string_is_found():
    scan, key = secrets.Scanner(), "q7ZxP2mK9vTbW4nR8sYc"
    for text in (f"{key}-123e4567-e89b-12d3-a456-426614174000", f"{key}Example", f"example{key}", f"placeholder{key}0123456789"):
        assert [text[s["start"] : s["end"]].strip("-") for s in scan(text)] == [key], text
    assert scan("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY") == []


def plain_entropy_spans(text):
    """Every window of every class looked at by itself, their unions marked place by place."""
    out = []
    for kind in secrets.CLASSES:
        held = set()
        for c in re.finditer(r"[A-Za-z0-9+/=_-]{20,}", text):
            barred = {i for x in secrets.ALLOWED for m in x.finditer(c[0]) for i in range(*m.span())}
            for i in range(len(c[0]) - kind.window + 1):
                part = c[0][i : i + kind.window]
                bits = -sum(part.count(a) / kind.window * math.log2(part.count(a) / kind.window) for a in set(part))
                if re.fullmatch(f"[{kind.members}]+", part) and bits >= kind.bits - 1e-12 and all(x.search(part) for x in kind.needs) and not barred & set(range(i, i + kind.window)):
                    held.add((c.start() + i, c.start() + i + kind.window))
        for a, b in sorted(held):
            if out and out[-1][2] == kind.kind and a <= out[-1][1]:
                out[-1] = (out[-1][0], b, kind.kind)
            else:
                out.append((a, b, kind.kind))
    return sorted(out)


def test_entropy_spans_match_brute_force():
    rnd = random.Random(4)
    parts = ["q7ZxP2mK9vTbW4nR8sYc", "example", "123e4567-e89b-12d3-a456-426614174000", "0A1B2C3D4E5F60718293A4B5", " ", "-", "aaaaaaaaaa", "xxxxxxxx", "/K7+", "=", "Hj3", "0123456789", "\u00e9"]
    seen = 0
    for _ in range(400):
        text = "".join(rnd.choices(parts, k=rnd.randrange(1, 9)))
        got = sorted(secrets.Scanner().entropic(text, []))
        want = [x for x in plain_entropy_spans(text)]
        assert got == want, text
        seen += len(got)
    assert seen > 200


def test_redaction(spark):
    frame = docs(spark, [None, "plain", "password=hunter22 and zX9qLm3Vt7Kp2Rw8Yc5Nd1Hs!", "token=0123456789abcdef0123456789 x"])
    out = [r[0] for r in frame.select("doc_id", secrets.redacted(frame.text).alias("t")).orderBy("doc_id").select("t").collect()]
    assert out == [None, "plain", "<secret> and <secret>!", "<secret> x"]


# ---- op9


def brute_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


def test_url_filters_match_brute_force(spark):
    random.seed(2)
    rules = [*url_filters.RULES, ("a.b.example.org", "", "block"), ("net", "/", "block")]
    hosts = ["example.org", "EXAMPLE.org", "notexample.org", "a.b.example.org", "x.a.b.example.org", "com", "shop.com", "", "a..org", "org.", "h.net:80"]
    paths = ["", "/", "/es", "/es/", "/es/x?y=/de/", "/en/1", "/en/12#z", "/fr/a", "/de/", "?/de/", "#/es/", "/EN/1"]
    urls = [None, "", "no scheme", "://", "a://b://example.org/es/", "http://example.org/es/\nx", *(f"http{random.choice(['', 's'])}://{random.choice(hosts)}{random.choice(paths)}" for _ in range(300))]
    frame = spark.createDataFrame([(i if i else None, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, digest string")
    for rule_set in (rules, []):
        rows = url_filters.filter_urls(frame, rule_set).collect()
        assert len(rows) == len(urls)
        for r in rows:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(r["url"], rule_set), r
    assert url_filters.filter_urls(frame.limit(0), rules).count() == 0
