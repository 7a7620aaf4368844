"""Files of any bytes, written by the tasks that hold them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content) as one file each under `folder` (a URI); returns (name, bytes) as they are written.

    A file is written beside its place and moved there, so that a task that runs again replaces it by the same bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                with fs.open_output_stream(f"{base}/.{name}.part", compression=None) as out:
                    out.write(content)
                fs.move(f"{base}/.{name}.part", f"{base}/{name}")
            yield pd.DataFrame({"name": pdf["name"], "bytes": pdf["content"].map(len)})

    return files.select("name", "content").mapInPandas(run, "name string, bytes long")
