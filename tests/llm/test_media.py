"""Colour files with subsampling through the DC-only decoder."""

import numpy as np
import pytest

from volumetra.llm import media


def colour(width, height, luma, h=2, v=2):
    """A three-component file; luma: DC grey of each block of the first component, in rows, for whole MCUs."""
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    bits, before = "", 0

    def block(diff):
        size = abs(diff).bit_length()
        extra = diff if diff > 0 else diff + (1 << size) - 1
        return f"{size:04b}" + (f"{extra:0{size}b}" if size else "") + "0"

    for y in range(down):
        for x in range(across):
            for j in range(v):
                for i in range(h):
                    dc = int(luma[y * v + j][x * h + i]) - 128
                    bits += block(dc - before)
                    before = dc
            bits += block(3 if (x, y) == (0, 0) else 0) + block(-2 if (x, y) == (0, 0) else 0)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = media._segment
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0])
    tables = seg(0xC4, bytes([0]) + media.DC_COUNTS + media.DC_VALUES) + seg(0xC4, bytes([0x10]) + media.AC_COUNTS + media.AC_VALUES)
    return b"\xff\xd8" + seg(0xDB, bytes([0, *[8] * 64])) + seg(0xC0, frame) + tables + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("width,height,h,v", [(8, 8, 2, 2), (20, 12, 2, 2), (33, 9, 2, 1), (17, 40, 1, 2), (24, 16, 1, 1)])
def test_subsampled_colour_is_cropped_to_the_image(width, height, h, v):
    rng = np.random.default_rng(width)
    luma = rng.integers(0, 256, (-(-height // (8 * v)) * v, -(-width // (8 * h)) * h))
    ((w, t, grey),) = media.thumbnails([colour(width, height, luma, h, v)])[0]
    assert (w, t) == (width, height)
    assert grey.tolist() == luma[: -(-height // 8), : -(-width // 8)].tolist()
