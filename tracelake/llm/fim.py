"""Fill-in-the-middle transformation by one numpy kernel over the UTF-8 bytes of many documents at once.

A table gives every byte its class (blank, continuation byte, other). A token begins where a blank follows what is not one,
and where a document begins; cumulative sums that restart with each document number the tokens, and one searchsorted finds the
cuts of all documents together. Only the pieces are then joined and digested row by row.

A document's draws come from a digest of the seed and its id, so that a row always has the same form, wherever it is computed.
Texts that hold a marker stay plain: so a form's first markers are always its own, and `restored` is exact.

Defined cases: null and empty texts are plain with no tokens; blanks alone are one token, blanks at the end one of their own;
a null id is drawn for as an empty one; repeated rows give repeated results; documents are never cut or merged, and a batch
holds whole texts, so a long text needs some thirty times its size in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tracelake.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FORMS = ("plain", "psm", "spm")
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
BATCH_BYTES = 4 << 20
_BLANK, _CONTINUED = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[0x80:0xC0] = _CONTINUED


def draws(ids: list, seed: int = SEED) -> np.ndarray:
    """Four unsigned 32-bit numbers for every id: the first digits of the digest of `seed:id`."""
    made = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(made, ">u4").reshape(-1, 4).astype(np.int64)


def marked_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds one of the three markers."""
    out = np.zeros(len(offsets) - 1, bool)
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], list(b"PSM")))
        row = np.searchsorted(offsets, at, "right") - 1
        out[row[at + 2 < offsets[row + 1]]] = True
    return out


def kernel(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> dict[str, np.ndarray]:
    """data: bytes of all texts; offsets: where each begins, and the end of the last; h: draws(). Gives a value a text: n
    tokens, form (index into FORMS), the bytes where prefix and middle end, and their characters."""
    begin, end = offsets[:-1], offsets[1:]
    kind = _CLASS[data]
    blank = kind == _BLANK
    starts = np.zeros(len(data), bool)
    starts[1:] = blank[1:] & ~blank[:-1]
    starts[begin[begin < end]] = True
    tokens = np.cumsum(starts)
    seen = np.concatenate(([0], tokens))
    before = seen[begin]
    n = seen[end] - before
    cuts = np.sort(np.stack((h[:, 0] % (n + 1), h[:, 1] % (n + 1))), axis=0)
    at = np.where(cuts < n, np.searchsorted(tokens, before + cuts + 1), end)
    chars = np.concatenate(([0], np.cumsum(kind != _CONTINUED)))
    plain = (n == 0) | (h[:, 2] % 100 >= fim_percent) | marked_rows(data, offsets)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm_percent, 2, 1))
    return {"n": n, "form": form, "prefix_end": at[0], "middle_end": at[1], "prefix_chars": chars[at[0]] - chars[begin], "middle_chars": chars[at[1]] - chars[at[0]]}


def _buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow column of texts; nulls are empty."""
    import pyarrow as pa

    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def arranged(data: np.ndarray, offsets: np.ndarray, cut: dict[str, np.ndarray]) -> list[bytes]:
    """The bytes of every row's form."""
    whole, p, s, m = data.tobytes(), PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for a, x, y, b, form in zip(offsets[:-1].tolist(), cut["prefix_end"].tolist(), cut["middle_end"].tolist(), offsets[1:].tolist(), cut["form"].tolist()):
        if form == 0:
            out.append(whole[a:b])
        elif form == 1:
            out.append(b"".join((p, whole[a:x], s, whole[y:b], m, whole[x:y])))
        else:
            out.append(b"".join((s, whole[y:b], p, whole[a:x], m, whole[x:y])))
    return out


def fill_in_middle(docs: DataFrame, *, keep: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per row of docs: the columns in keep, then doc_id, n, form, prefix_chars, middle_chars (null if plain), output."""
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    added = StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output string").fields
    schema = StructType([*source.schema.fields[:-1], *[StructField(f"n{i}", f.dataType) for i, f in enumerate(added)]])
    names, k = schema.names, len(keep) + 1

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = np.cumsum(np.diff(_buffers(batch.column(k))[1]))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + BATCH_BYTES)))
                part = batch.slice(start, stop - start)
                data, offsets = _buffers(part.column(k))
                cut = kernel(data, offsets, draws(part.column(k - 1).to_pylist(), seed), fim_percent, spm_percent)
                plain = cut["form"] == 0
                made = pa.array(arranged(data, offsets, cut), pa.binary()).cast(pa.string(), safe=False)
                new = [pa.array(cut["n"]), pa.array(np.array(FORMS, object)[cut["form"]]), pa.array(cut["prefix_chars"], mask=plain), pa.array(cut["middle_chars"], mask=plain), made]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *new], names=names)
                start = stop

    return source.mapInArrow(run, schema).toDF(*keep, doc_id, *[f.name for f in added])


def restored(output: Column, form: Column) -> Column:
    """The text that a form was made from."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    first = F.split(body, F.when(form == "psm", SUFFIX).otherwise(PREFIX), 2)
    second = F.split(first[1], MIDDLE, 2)
    psm, spm = F.concat(first[0], second[1], second[0]), F.concat(second[0], second[1], first[0])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w,
 [cast('0x' || h[8 * i + 1:8 * i + 8] as bigint) for i in range(4)] as h from d),
c as (select *, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) as a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) as b,
 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(w[1:a], '') as pre, array_to_string(w[a + 1:b], '') as mid, array_to_string(w[b + 1:], '') as suf from c)
select doc_id, cast(len(w) as bigint) as n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
 sha256(pre || mid || suf) as restored_sha256
from p
"""
