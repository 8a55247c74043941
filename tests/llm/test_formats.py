"""Chat formatting, token counts and media: exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tidewheel.llm import chat, jpeg, media, tokencount

TALKS = [
    (1, 0, "system", "be <|im_end|>\n nice"), (1, 1, "user", "a\\b <| c"), (1, 2, "assistant", "x <|im_start|>assistant\nok"), (1, 3, "user", ""), (1, 4, "assistant", "<\\| \\\\ é\U0001f600"), (1, 5, "user", "bye"),
    (2, 0, "user", "only a user"), (3, 1, "assistant", None), (3, 0, "as\nsist<|", "role"), (4, None, None, None), (None, 0, "assistant", "nowhere"), (5, 0, "user", "twice"), (5, 0, "user", "twice"), (5, 1, "assistant", "r"), (5, 1, "assistant", "r"),
]


def talks(spark):
    return spark.createDataFrame([(*t, "extra") for t in TALKS], "conv_id long, turn long, role string, text string, rendered string")


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))


def test_chat_round_trip(spark):
    got = {r.conv_id: r for r in chat.digest(talks(spark)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None, -1}
    for conv in (1, 2, 3, 4, 5, None):
        rows = order([t for t in TALKS if t[0] == conv])
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
        loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_every_assistant_turn_is_an_example(spark):
    rows = chat.examples(talks(spark)).collect()
    mine = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.example)
    assert len(mine) == 3 and [r.whole for r in mine] == [False, False, True]
    assert [r.loss_end > r.loss_start for r in mine] == [True, True, False]
    for r in mine[:2]:
        assert mine[2].text.startswith(r.text)  # context and reply are a prefix of the conversation
        assert r.text.endswith(chat.END) and r.text[r.loss_end :] == chat.END
        assert chat.START not in r.text[r.loss_start : r.loss_end]
    assert len([r for r in rows if r.conv_id == 5]) == 2
    assert chat.examples(talks(spark).limit(0)).count() == 0


def test_no_python_in_the_chat_plan(spark):
    plan = chat.digest(talks(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def slow_attribute(stops, sections, rule):
    counts, crossing, start = [0] * len(sections), 0, 0
    for stop in stops:
        over, begin = [], 0
        for k, end in enumerate(sections):
            n = min(stop, end) - max(start, begin)
            if n > 0:
                over.append((n, k))
            begin = end
        crossing += len(over) > 1
        counts[{"start": over[0][1], "end": over[-1][1], "largest": max(over, key=lambda x: (x[0], -x[1]))[1]}[rule]] += 1
        start = stop
    return counts, crossing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.data())
def test_attribution_against_intervals(sizes, data):
    stops = np.cumsum(sizes)
    cuts = data.draw(st.lists(st.integers(0, int(stops[-1])), max_size=8))
    sections = np.array([*sorted(cuts), int(stops[-1])])
    for rule in tokencount.RULES:
        counts, crossing = tokencount.attribute(stops, sections, rule)
        assert (counts.tolist(), crossing) == slow_attribute(stops.tolist(), sections.tolist(), rule)


def test_token_counts(spark):
    df = cases.docs(spark)
    encoding, sizes = tokencount.coder(*tokencount.default_vocabulary())
    for r in tokencount.with_token_counts(df).collect():
        t, raw = r.tokens, (r.text or "").encode()
        ids = encoding.encode_ordinary(r.text or "")
        assert t.n_tokens == len(ids) == sum(t.section_tokens) and sum(t.section_bytes) == len(raw) == sizes[ids].sum()
        assert len(t.section_tokens) == max(1, raw.count(b"\n") + (not raw.endswith(b"\n")))
    with_ends = df.selectExpr("*", "array(4, 9) AS ends")
    got = tokencount.with_token_counts(with_ends, "ends", "start").where("doc_id = 1").first().tokens
    assert sum(got.section_tokens) == got.n_tokens and got.section_bytes[:2] == [4, 5]
    assert tokencount.with_token_counts(cases.none(spark)).count() == 0
    with pytest.raises(ValueError, match="rule"):
        tokencount.with_token_counts(df, rule="middle")


def test_zigzag():
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and jpeg.ZIGZAG[-2:].tolist() == [62, 63] and sorted(jpeg.ZIGZAG.tolist()) == list(range(64))


@pytest.mark.parametrize("density", [0.0, 0.03, 0.5, 1.0])
def test_jpeg_round_trip(density):
    rng = np.random.default_rng(int(density * 100))
    blocks = np.array([1, 6, 7, 55, 400])
    layout = jpeg.Layout.of(*jpeg.grid(blocks))
    coef = rng.integers(-128, 128, (int(layout.first[-1]), 64)).astype(np.int16)
    coef[rng.random(coef.shape) >= density] = 0
    coef[:, 6:40] //= 40
    files = jpeg.encode(coef, layout, [b"n"] * len(blocks))
    back, where, heads = jpeg.decode(files)
    assert (back == coef).all() and (where.first == layout.first).all()
    alone = np.concatenate([jpeg.decode([f])[0] for f in files])
    assert (alone == coef).all()
    assert len(heads[0].scans) == len(jpeg.SCRIPT)


def test_pixels_of_a_flat_image():
    layout = jpeg.Layout.of(np.array([1]), np.array([1]))
    coef = np.zeros((6, 64), np.int16)
    coef[:4, 0] = 8 * 40  # luma 168
    coef[5, 0] = 8 * 20  # red difference 148
    back, where, heads = jpeg.decode(jpeg.encode(coef, layout, [b""]))
    (rgb,) = jpeg.pixels(back, where, heads)
    assert rgb.shape == (16, 16, 3) and (rgb == rgb[0, 0]).all()
    assert rgb[0, 0].tolist() == [196, 154, 168]


def test_inverse_transform_against_its_definition():
    rng = np.random.default_rng(0)
    block = rng.integers(-30, 30, (8, 8))
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    want = [[128 + sum(c(u) * c(v) / 4 * block[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)]
    got = jpeg._COS.T @ block.astype(np.float32) @ jpeg._COS + 128
    assert np.allclose(got, want, atol=1e-2)


@pytest.mark.parametrize("bytes_", [1, 64 * 6 * 64 * 4095, 64 * 6 * 64 * 4095 + 1, 2**31 - 1])
def test_sides_stay_within_the_format(bytes_):
    blocks = np.array([-(-bytes_ // 64)])
    wide, high = jpeg.grid(blocks)
    assert 16 * wide[0] <= 65535 and 16 * high[0] <= 65535 and 6 * wide[0] * high[0] >= blocks[0]


def test_a_file_of_another_encoder(spark):
    """A progressive file that Java's image library writes, against the pixels that it reads from it."""
    jvm = spark.sparkContext._jvm
    side = 64
    image = jvm.java.awt.image.BufferedImage(side, side, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(side):
        for x in range(side):
            image.setRGB(x, y, (100 + x) << 16 | (60 + y) << 8 | (x + y) // 2 + 40)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    params = writer.getDefaultWriteParam()
    params.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), params)
    stream.flush()
    file = bytes(out.toByteArray())
    assert b"\xff\xc2" in file  # a progressive frame
    (rgb,) = jpeg.pixels(*jpeg.decode([file]))
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(out.toByteArray()))
    want = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(side)] for y in range(side)])
    want = np.stack([want >> 16, want >> 8 & 255, want & 255], 2)
    assert rgb.shape == want.shape and np.abs(rgb.astype(int) - want).mean() < 3


def test_media_round_trip(spark):
    df = cases.docs(spark)
    rows = media.media_columns(df).collect()
    assert len(rows) == df.count()
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    for r in rows:
        raw = texts[r.doc_id]
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, bytes(r.payload)) == (len(raw), want)
        assert len(r.tensor) == r.height * r.width * 3 and bytes(r.media)[:2] == b"\xff\xd8"
        assert media.load([bytes(r.media)])[0][0] == want
    assert len({bytes(r.media) for r in rows if r.doc_id in (3, 4)}) == 1
    assert media.media_columns(cases.none(spark)).count() == 0


def test_media_query(spark, sf):
    from tidewheel.llm.queries import QUERIES

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op10_media"](spark, sf).collect():
        want = texts[r.doc_id] + bytes(-len(texts[r.doc_id]) % 64 if texts[r.doc_id] else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))


def test_token_query(spark, sf):
    from tidewheel.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: r.tokens for r in tokencount.with_token_counts(docs).collect()}
    rows = QUERIES["op3_token_counts"](spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_tokens, r.n_crossing, r.section_tokens) == (want[r.doc_id].n_tokens, want[r.doc_id].n_crossing, want[r.doc_id].section_tokens)
        assert sum(r.section_tokens) == r.n_tokens and r.n_sections == len(r.section_tokens)
