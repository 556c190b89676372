"""Media columns: texts as lossless WebP images, and pixel arrays of lossless WebP files.

``stored`` turns a text's UTF-8 bytes, padded with spaces to rows of 192, into 8-bit samples of a lossless image (more than 16,384 rows
into several, one file after the other). ``pixels`` decodes any lossless WebP files. See ``webp`` for the format's tools.

Defined results: a null or empty text is one row of spaces; a null or broken file has null pixels; equal texts give equal files;
repeated rows are kept; an empty table gives an empty result; added columns replace clashing ones.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import webp
from .frames import map_texts, plus, table

ROW = webp.WIDTH
BANDS = 8


def stored(docs: DataFrame) -> DataFrame:
    """docs with text -> also n_bytes (unpadded) and media (the files)."""

    def make():
        def work(texts):
            raws = [(t or "").encode() for t in texts]
            files = [webp.encode_all(np.frombuffer(r + b" " * (-len(r) % ROW if r else ROW), np.uint8)) for r in raws]
            return [pa.array(map(len, raws), pa.int64()), pa.array(files, pa.binary())]

        return work

    return map_texts(docs, make, "n_bytes long, media binary", rows=128)


def _decoded(files: DataFrame, columns: list[str], each, **added: str) -> DataFrame:
    """files with media -> the columns and what ``each`` returns for the decoded images (None if they can't be decoded)."""
    source = files.select(*columns, "media")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = []
                for media in part.column("media").to_pylist():
                    try:
                        images = None if media is None else webp.decode_all(media)
                    except (ValueError, IndexError):
                        images = None
                    rows.append(each(media, images))
                found = [pa.array(x, kinds[k]) for x, k in zip(zip(*rows) if rows else [()] * len(added), added.values())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + found, names=[*columns, *added])

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    return source.mapInArrow(run, plus(source.select(*columns).schema, **added))


def pixels(files: DataFrame) -> DataFrame:
    """files with media (one WebP file each) -> also width, height and rgba (samples row by row)."""

    def each(media, images):
        return (None, None, None) if not images else (images[0].shape[1], images[0].shape[0], images[0].tobytes())

    return _decoded(files, [c for c in files.columns if c not in ("media", "width", "height", "rgba")], each, width="int", height="int", rgba="binary")


def feature(samples: np.ndarray) -> str:
    """Means of eight bands of rows (in tenths) and the histogram of sample values by sixteens, as text."""
    edges = [len(samples) * i // BANDS for i in range(BANDS + 1)]
    means = [int(samples[a:b].sum(dtype=np.int64) * 10 // (b - a)) for a, b in zip(edges, edges[1:])]
    counts = np.bincount(samples >> 4, minlength=16)
    return "bands:" + ",".join(map(str, means)) + ";histogram:" + ",".join(map(str, counts.tolist()))


def op6_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    def each(media, images):
        samples = np.concatenate([i[..., 1].ravel() for i in images])
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)

    files = stored(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return _decoded(files, ["doc_id", "n_bytes"], each, payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string", feature="string")
