"""HDF5 files that the tests write by the published format, read back."""

import struct
import zlib

import numpy as np
import pytest

from scenemill.sources import frames

U = (1 << 64) - 1


class Writer:
    """Objects laid one after another; addresses are known once they are written."""

    def __init__(self):
        self.data = bytearray(96)

    def put(self, block: bytes) -> int:
        self.data += bytes(-len(self.data) % 8)
        self.data += block
        return len(self.data) - len(block)

    def object(self, messages, split=None) -> int:
        """split: the messages from there on stand in a block of their own."""
        pack = lambda ms: b"".join(struct.pack("<HHB3x", k, len(b) + -len(b) % 8, 0) + b + bytes(-len(b) % 8) for k, b in ms)
        if split is not None:
            rest = pack(messages[split:])
            messages = messages[:split] + [(0x10, struct.pack("<QQ", self.put(rest), len(rest)))]
            total = len(messages) + self.moved
        else:
            total = len(messages)
        body = pack(messages)
        return self.put(struct.pack("<BxHII4x", 1, total, 1, len(body)) + body)

    def tree(self, kind, keys, children, last):
        body = b"".join(k + struct.pack("<Q", c) for k, c in zip(keys, children)) + last
        return self.put(struct.pack("<4sBBHQQ", b"TREE", kind, 0, len(children), U, U) + body)

    def group(self, members: dict) -> int:
        names, offsets = bytearray(8), {}
        for n in sorted(members):
            offsets[n] = len(names)
            names += n.encode() + b"\0"
            names += bytes(-len(names) % 8)
        heap = self.put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(names), U, self.put(bytes(names))))
        nodes, ordered = [], sorted(members)
        for k in range(0, len(ordered), 2):
            own = ordered[k : k + 2]
            nodes.append(self.put(struct.pack("<4sBxH", b"SNOD", 1, len(own)) + b"".join(struct.pack("<QQII16x", offsets[n], members[n], 0, 0) for n in own)))
        tree = self.tree(0, [bytes(8)] * len(nodes), nodes, bytes(8))
        return self.object([(0x11, struct.pack("<QQ", tree, heap))])

    def dataset(self, a: np.ndarray, chunk=None, shuffle=False, version=1, compact=False, split=None) -> int:
        space = struct.pack("<BBB5x", 1, a.ndim, 0) if version == 1 else struct.pack("<BBBB", 2, a.ndim, 0, 1)
        messages = [(0x01, space + struct.pack(f"<{a.ndim}Q", *a.shape))]
        kind, bits = {"i": (0, 8), "u": (0, 0), "f": (1, 0), "S": (3, 0)}[a.dtype.kind]
        messages.append((0x03, struct.pack("<BBBBI", 16 + kind, bits | (a.dtype.byteorder == ">"), 0, 0, a.dtype.itemsize) + bytes(8)))
        if chunk is None:
            raw = a.tobytes()
            messages.append((0x08, struct.pack("<BBH", 3, 0, len(raw)) + raw if compact else struct.pack("<BBQQ", 3, 1, self.put(raw), len(raw))))
        else:
            keys, children = [], []
            for start in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunk)]):
                at = [s * c for s, c in zip(start, chunk)]
                part = np.zeros(chunk, a.dtype)
                own = a[tuple(slice(s, s + c) for s, c in zip(at, chunk))]
                part[tuple(slice(0, n) for n in own.shape)] = own
                raw = part.tobytes()
                if shuffle:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
                raw = zlib.compress(raw)
                children.append(self.put(raw))
                keys.append(struct.pack(f"<II{a.ndim + 1}Q", len(raw), 0, *at, 0))
            tree = self.tree(1, keys, children, bytes(8 + 8 * (a.ndim + 1)))
            messages.append((0x08, struct.pack("<BBBQ", 3, 2, a.ndim + 1, tree) + struct.pack(f"<{a.ndim + 1}I", *chunk, a.dtype.itemsize)))
            one = lambda n, v: struct.pack("<HHHH", n, 0, 1, 1) + struct.pack("<II", v, 0) if version == 1 else struct.pack("<HHHI", n, 1, 1, v)
            filters = ([one(2, a.dtype.itemsize)] if shuffle else []) + [one(1, 4)]
            messages.append((0x0B, (struct.pack("<BB6x", 1, len(filters)) if version == 1 else struct.pack("<BB", 2, len(filters))) + b"".join(filters)))
        self.moved = len(messages) - (split or 0)
        return self.object(messages, split)

    def file(self, root: int) -> bytes:
        head = frames.SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, U, len(self.data), U) + struct.pack("<QQII16x", 0, root, 0, 0)
        self.data[: len(head)] = head
        return bytes(self.data)


ARRAYS = {
    "colors": np.random.default_rng(0).integers(0, 256, (50, 70, 3)).astype("u1"), "depth": np.random.default_rng(1).normal(2, 1, (50, 70)).astype("<f4"), "big": np.arange(12, dtype=">i4").reshape(3, 4),
    "wide": np.linspace(0, 1, 5), "note": np.array(b"a render"), "group/mask": np.arange(35, dtype="<u2").reshape(5, 7),
}


def written() -> bytes:
    w = Writer()
    inner = w.group({"mask": w.dataset(ARRAYS["group/mask"], (2, 3), shuffle=True, version=2)})
    return w.file(w.group({
        "colors": w.dataset(ARRAYS["colors"], (16, 32, 3)), "depth": w.dataset(ARRAYS["depth"], (50, 16), shuffle=True, split=2), "big": w.dataset(ARRAYS["big"]),
        "wide": w.dataset(ARRAYS["wide"], compact=True, version=2), "note": w.dataset(ARRAYS["note"]), "group": inner,
    }))


def test_arrays_of_a_file(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for name in ("0.hdf5", "r/1.hdf5"):
        (tmp_path / name).write_bytes(written())
    rows = frames.read_frames(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(ARRAYS)
    for r in rows:
        want = ARRAYS[r.dataset]
        got = np.frombuffer(r.data, r.dtype).reshape(r["shape"])
        assert got.shape == want.shape and (got == want).all() and got.dtype.kind == want.dtype.kind
    depth = frames.read_frames(spark, str(tmp_path), ["depth"])
    assert depth.count() == 2 and depth.first()["shape"] == [50, 70]
    with pytest.raises(Exception, match="no dataset lost"):
        frames.read_frames(spark, str(tmp_path), ["lost"]).collect()


def test_one_dataset_is_read_without_the_others():
    import io

    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            data = super().read(n)
            self.seen += len(data)
            return data

    f = Counted(written())
    file = frames.File(f)
    assert (file.array(dict(file.datasets())["big"]) == ARRAYS["big"]).all()
    assert f.seen < 4000 < len(f.getvalue()) / 4


def test_other_files_are_refused():
    import io

    with pytest.raises(ValueError, match="superblock"):
        frames.File(io.BytesIO(b"nothing of the kind" * 10))
