"""The block format stays as it was written before, and damage always shows as a ValueError."""

import zlib

import numpy as np
import pytest

from gradeloom.llm.token_files import decode_block, encode_block


def ids_of(n, alphabet):
    x = np.arange(n, dtype=np.uint64) * np.uint64(2654435761) % np.uint64(1 << 32) >> np.uint64(7)
    return ((x * x >> np.uint64(20)) % np.uint64(1 + alphabet // 7) * (x % np.uint64(3) + np.uint64(1)) % np.uint64(alphabet)).astype(np.uint32)


@pytest.mark.parametrize("n, alphabet, size, crc", [(40_000, 3000, 52_323, 0xD4C08C6), (1, 2, 23, 0x6B4ABAA), (120_000, 60_000, 236_133, 0xCE861B3D)])
def test_blocks_are_the_same_bytes_as_before(n, alphabet, size, crc):
    data = encode_block(ids_of(n, alphabet), alphabet)
    assert (len(data), zlib.crc32(data)) == (size, crc)
    assert (decode_block(data, alphabet) == ids_of(n, alphabet)).all()


def test_damage_is_found():
    data = encode_block(ids_of(20_000, 3000), 3000)
    rng = np.random.default_rng(1)
    for _ in range(40):
        bad = bytearray(data)
        for at in rng.integers(17 + 2 * 312, len(data), 4):  # in the words of lanes
            bad[at] ^= int(rng.integers(1, 256))
        if bytes(bad) == data:
            continue
        try:
            assert (decode_block(bytes(bad), 3000) == ids_of(20_000, 3000)).all()  # bits that no id needs
        except ValueError:
            pass
