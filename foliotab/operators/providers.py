"""Readers as checked functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Provider:
    """``read`` gets a batch of requests and returns one text (or null) for each, in their order."""

    name: str
    read: Callable[[pa.RecordBatch], pa.Array]


class ProviderError(TypeError):
    """A reader broke its agreement: no Arrow array of texts, or not one for each request."""


def _checked(provider: Provider, batch: pa.RecordBatch) -> list:
    found = provider.read(batch)
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    if not isinstance(found, pa.Array) or not (
            pa.types.is_string(found.type) or pa.types.is_large_string(found.type) or pa.types.is_null(found.type)):
        raise ProviderError(f"{provider.name} returned no array of texts")
    if len(found) != batch.num_rows:
        raise ProviderError(f"{provider.name} returned {len(found)} texts for {batch.num_rows} requests")
    return found.to_pylist()


def _answers(provider: Provider, batch: pa.RecordBatch) -> tuple[list, list]:
    """Texts and errors; a batch that fails is halved until the failing requests stand alone."""
    n = batch.num_rows
    if n == 0:
        return [], []
    try:
        return _checked(provider, batch), [None] * n
    except ProviderError:
        raise
    except Exception as error:  # a reader may fail in any way; the request carries what it said
        if n == 1:
            return [None], [f"{type(error).__name__}: {error}"]
        left, right = _answers(provider, batch.slice(0, n // 2)), _answers(provider, batch.slice(n // 2))
        return left[0] + right[0], left[1] + right[1]


def provider_outputs(requests: DataFrame, primary: Provider, fallback: Provider | None = None,
                     keys: tuple[str, ...] = ("doc_id",), batch_rows: int = 256) -> DataFrame:
    """One answer per request: ``keys, status, provider_used, output, error``.

    Requests that the primary reader fails on or answers with null or blank text go to the fallback.
    ``status`` is ``ok``, ``empty`` or ``failed``; ``error`` is the last one said, also where the
    fallback then answered.  A reader that breaks its agreement stops the job.  At most ``batch_rows``
    requests are in one call.  A recomputed task asks again: store the result before it is read twice.
    """
    schema = T.StructType([requests.schema[k] for k in keys] + [
        T.StructField(n, T.StringType()) for n in ("status", "provider_used", "output", "error")])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                texts, errors = _answers(primary, batch)
                used = [primary.name] * len(texts)
                again = [i for i, t in enumerate(texts) if not (t or "").strip()]
                if fallback is not None and again:
                    more, said = _answers(fallback, batch.take(pa.array(again, pa.int64())))
                    for i, text, error in zip(again, more, said):
                        used[i], texts[i], errors[i] = fallback.name, text, error or errors[i]
                status = ["ok" if (t or "").strip() else "failed" if e else "empty" for t, e in zip(texts, errors)]
                columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
                columns += [pa.array(v, pa.string()) for v in (status, used, texts, errors)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "status", "provider_used", "output", "error"])

    return requests.mapInArrow(ask, schema)
