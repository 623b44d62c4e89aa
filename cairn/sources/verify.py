"""Which payloads are decoded, and whether they come back as they were."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.sources import bags, payloads
from cairn.sources.resource_types import codes

#: Types whose payload is a property bag, by abbreviation.
BAGS = ("TRKS", "XFLR", "XNGB", "XWNT", "XMOL", "XFMD", "XTOL", "XFNC", "XSTN", "MMAT", "COLL", "XFNU", "XHTN", "XFRG", "XFCH", "XSIM", "XROF", "PBOP", "XWLL", "SDNA", "VERS", "GZPS", "BINX")
TEXTS = ("STR", "CTSS", "TTAS")


def codecs() -> dict[int, tuple[str, Callable, Callable]]:
    """Kind, reader and writer by type code."""
    one = lambda kind, c: (kind, c.read, lambda x: x.write())
    found = {t: ("bag", bags.read, bags.write_binary) for t in codes(BAGS)}
    found |= {t: one("text", payloads.TextList) for t in codes(TEXTS)}
    for kind, abbr, c in (("constants", "BCON", payloads.Constants), ("function", "BHAV", payloads.Function), ("outfits", "3IDR", payloads.Outfits), ("audio", "FWAV", payloads.AudioReference)):
        found |= {t: one(kind, c) for t in codes([abbr])}
    return found


def verified(rows: DataFrame) -> DataFrame:
    """path, type_id, group_id, instance_hi, instance_lo, kind, status for every row (data, unpacked): `same`, `changed`, an error's text, or null without a codec.

    A payload is the same if what it decodes to, written and read again, is equal; bytes may differ.
    """
    known = codecs()
    names = ("path", "type_id", "group_id", "instance_hi", "instance_lo")

    def status(read: Callable, write: Callable, data: bytes) -> str:
        try:
            value = read(data)
            return "same" if repr(read(write(value))) == repr(value) else "changed"
        except Exception as e:  # noqa: BLE001  a decoder's failure is a result here
            return f"error: {type(e).__name__}: {e}"

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            kinds, out = [], []
            for t, data in zip(batch.column("type_id").to_pylist(), batch.column("data")):
                kind, read, write = known.get(t, (None, None, None))
                kinds.append(kind)
                out.append(None if kind is None or not data.is_valid else status(read, write, data.as_py()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(kinds, pa.string()), pa.array(out, pa.string())], [*names, "kind", "status"])

    return rows.select(*names, "data").mapInArrow(run, "path string, type_id long, group_id long, instance_hi long, instance_lo long, kind string, status string")
