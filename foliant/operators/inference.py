"""The boundary to neural recognisers: any callable over batches of crops, run in Arrow batches.

No weights are shipped. ``stub`` stands in for tests; its output says nothing
about recognition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Recogniser = Callable[[list[bytes]], list[str]]


def stub(crops: list[bytes]) -> list[str]:
    """A text that depends on the bytes alone."""
    return [f"crop-{hashlib.sha256(c or b'').hexdigest()[:12]}" for c in crops]


def recognise(crops: DataFrame, make: Callable[[], Recogniser], batch: int = 20, column: str = "data") -> DataFrame:
    """crops plus ``raw_content`` and ``error``. ``make`` builds the recogniser once in each worker.

    A batch that fails is tried again crop by crop; a crop that still fails
    gets empty content and its error.
    """
    schema = crops.schema.simpleString()[len("struct<") : -1] + ",raw_content:string,error:string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in batches:
            texts: list[str] = []
            errors: list[str | None] = []
            data = frame[column].tolist()
            for i in range(0, len(data), batch):
                part = data[i : i + batch]
                try:
                    texts += model(part)
                    errors += [None] * len(part)
                except Exception:
                    for crop in part:
                        try:
                            texts += model([crop])
                            errors.append(None)
                        except Exception as e:
                            texts.append("")
                            errors.append(str(e))
            yield frame.assign(raw_content=texts, error=errors)

    return crops.mapInPandas(run, schema)


def routed_recognise(crops: DataFrame, models: dict[str, Callable[[], Recogniser]], route: str = "route") -> DataFrame:
    """Each route by its own recogniser; the branches are independent parts of one job."""
    parts = [recognise(crops.filter(F.col(route) == name), make) for name, make in models.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def failures(recognised: DataFrame) -> DataFrame:
    """Failed formula crops with running file names."""
    from pyspark.sql import Window

    failed = recognised.filter("error is not null or raw_content = ''")
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("det_id"))
    return failed.withColumn("file", F.format_string("formula_%03d.png", n))
