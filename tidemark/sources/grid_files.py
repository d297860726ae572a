"""Grids in text files as a Spark data source: OPeNDAP responses (.asc) and ERDDAP tables (.csv).

    grid_files.register(spark)
    spark.read.format("tidemark_grid").option("variable", "anom").load(folder).where("latitude between -5 and 5")

Each file is a partition of its own. Files say in their names what they hold, as file_name() writes them:

    anom_1997-01-01_1997-12-31_-30_30_120_290.asc

Conditions on time, latitude and longitude are pushed down: a file whose name excludes them is not opened, and rows
that fail them are not made. Spark checks the conditions again, so they only save work. A file of another name is always
opened. Writing rows (name, text) to the same format makes such files, each complete or not there.

Options: variable; time_unit, hours or days since 1800-01-01, for OPeNDAP axes; limit, the largest size of a file in MB,
as a response is read whole (64). Drivers and executors reach the folder by pyarrow, so it needs a scheme that pyarrow
knows, such as file, hdfs or s3.

Defined cases: NaN, missing markers and sizes of a million or more are null; a response without the variable, without an
axis, or with a row of another length raises with the file's name; an empty folder gives no rows.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

FORMAT = "tidemark_grid"
SCHEMA = "file string, time timestamp, latitude double, longitude double, value double"
EPOCH = dt.datetime(1800, 1, 1, tzinfo=dt.UTC)
#: Missing markers of the CSV services, in lower case, and the size from which a value is none.
MISSING, NONE_FROM = {"", "nan", "na", "-999", "-999.0"}, 1e6
_NAME = re.compile(r"_(\d{4}-\d\d-\d\d)_(\d{4}-\d\d-\d\d)(?:_(-?[\d.]+)_(-?[\d.]+)_(-?[\d.]+)_(-?[\d.]+?))?\.(?:asc|csv)$")

Ranges = dict[str, tuple[float, float]]


def file_name(variable: str, first: dt.date, last: dt.date, box: tuple[float, float, float, float] | None = None, kind: str = "asc") -> str:
    """A name that tells the days and the box (south, north, west, east) of a file, ends included."""
    return f"{variable}_{first:%Y-%m-%d}_{last:%Y-%m-%d}" + "".join(f"_{x:g}" for x in box or ()) + f".{kind}"


def bounds_of(name: str) -> Ranges:
    """What a name tells: ranges of time (seconds), latitude and longitude, ends included."""
    found = _NAME.search(name)
    if not found:
        return {}
    first, last = (dt.datetime.fromisoformat(found[i]).replace(tzinfo=dt.UTC) for i in (1, 2))
    told = {"time": (first.timestamp(), (last + dt.timedelta(days=1)).timestamp() - 1e-6)}
    if found[3]:
        told |= {"latitude": (float(found[3]), float(found[4])), "longitude": (float(found[5]), float(found[6]))}
    return told


def ranges_of(filters: Sequence[Filter]) -> Ranges:
    """The ranges that conditions leave; conditions of other kinds and columns leave all."""
    found: Ranges = {}
    for f in filters:
        if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.attribute[0] not in ("time", "latitude", "longitude"):
            continue
        value = f.value
        if isinstance(value, dt.datetime):
            value = (value if value.tzinfo else value.replace(tzinfo=dt.UTC)).timestamp()
        if not isinstance(value, (int, float)):
            continue
        low, high = found.get(f.attribute[0], (-np.inf, np.inf))
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            low = max(low, float(value))
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            high = min(high, float(value))
        found[f.attribute[0]] = (low, high)
    return found


def inside(x: np.ndarray, found: Ranges, column: str) -> np.ndarray:
    low, high = found.get(column, (-np.inf, np.inf))
    return (x >= low) & (x <= high)


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def numbers(cells: list[str]) -> np.ndarray:
    """Cells as numbers; NaN for missing markers and for sizes that stand for none."""
    x = np.array([np.nan if c.strip().lower() in MISSING else float(c) for c in cells])
    return np.where(np.abs(x) < NONE_FROM, x, np.nan)


def opendap_rows(text: str, variable: str, hours: int, wanted: Ranges) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Time, latitude, longitude and value of the cells of a response that the ranges leave, a row of the grid at a time."""
    head = re.search(rf"^\s*{re.escape(variable)}\.{re.escape(variable)}\[", text, re.M)
    if not head:
        raise ValueError(f"no data of {variable}")

    def axis(name: str) -> np.ndarray:
        found = re.search(rf"^\s*{re.escape(variable)}\.{name}\[\d+\]\s*\n([^\n]+)", text, re.M)
        if not found:
            raise ValueError(f"no axis {name} of {variable}")
        return np.array([float(c) for c in found[1].split(",")])

    times = EPOCH.timestamp() + axis("time") * hours * 3600
    lats, lons = axis("lat"), axis("lon")
    when, where, along = inside(times, wanted, "time"), inside(lats, wanted, "latitude"), np.flatnonzero(inside(lons, wanted, "longitude"))
    block = re.split(r"\n\s*\n", text[head.start() :], maxsplit=1)[0]
    for line in block.split("\n")[1:]:
        places, _, cells = line.strip().partition(",")
        index = [int(i) for i in re.findall(r"\[(\d+)\]", places)]
        if len(index) < 2:
            continue
        t, y = index[0], index[-1]
        if not (when[t] and where[y]):
            continue
        values = numbers(cells.split(","))
        if len(values) != len(lons):
            raise ValueError(f"a row of {len(values)} cells for {len(lons)} longitudes")
        n = len(along)
        yield np.full(n, times[t]), np.full(n, lats[y]), lons[along], values[along]


def erddap_rows(text: str, variable: str, wanted: Ranges) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same of a table with a line of names and a line of units."""
    names, _, *lines = [line.split(",") for line in text.splitlines()] or [[], []]
    try:
        at = [names.index(c) for c in ("time", "latitude", "longitude", variable)]
    except ValueError as e:
        raise ValueError(f"column is absent: {e}") from None
    rows = [c for c in lines if len(c) == len(names)]
    time = np.array([dt.datetime.fromisoformat(c[at[0]]).replace(tzinfo=dt.UTC).timestamp() for c in rows])
    lat, lon, value = (numbers([c[i] for c in rows]) for i in at[1:])
    keep = inside(time, wanted, "time") & inside(lat, wanted, "latitude") & inside(lon, wanted, "longitude")
    yield time[keep], lat[keep], lon[keep], value[keep]


class OneFile(InputPartition):
    def __init__(self, name: str, size: int):
        super().__init__(name)
        self.name, self.size = name, size


class GridReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.variable = options["path"], options["variable"]
        self.hours = {"hours": 1, "days": 24}[options.get("time_unit", "hours")]
        self.limit = float(options.get("limit", "64")) * 1e6
        self.wanted: Ranges = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        self.wanted = ranges_of(filters)
        yield from filters

    def partitions(self) -> list[OneFile]:
        from pyarrow import fs

        files, base = opened(self.folder)
        found = [f for f in files.get_file_info(fs.FileSelector(base)) if f.base_name.endswith((".asc", ".csv"))]
        return [OneFile(f.base_name, f.size) for f in sorted(found, key=lambda f: f.base_name) if self.may_hold(f.base_name)] or [OneFile("", 0)]

    def may_hold(self, name: str) -> bool:
        told = bounds_of(name)
        return all(told[c][0] <= high and told[c][1] >= low for c, (low, high) in self.wanted.items() if c in told)

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        if partition.size > self.limit:
            raise ValueError(f"{partition.name}: larger than {self.limit / 1e6:g} MB")
        files, base = opened(self.folder)
        with files.open_input_stream(f"{base}/{partition.name}") as stream:
            text = stream.read().decode()
        made = opendap_rows(text, self.variable, self.hours, self.wanted) if partition.name.endswith(".asc") else erddap_rows(text, self.variable, self.wanted)
        try:
            for time, lat, lon, value in made:
                columns = [pa.array([partition.name] * len(time)), pa.array((time * 1e6).round().astype("datetime64[us]"), pa.timestamp("us", "UTC")), pa.array(lat), pa.array(lon), pa.array(value, mask=np.isnan(value))]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "time", "latitude", "longitude", "value"])
        except ValueError as e:
            raise ValueError(f"{partition.name}: {e}") from None


class GridWriter(DataSourceWriter):
    """Files of rows (name, text). A file gets its name once it is complete, so a task that runs again leaves the same."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> WriterCommitMessage:
        files, base = opened(self.folder)
        files.create_dir(base, recursive=True)
        for row in iterator:
            draft = f"{base}/.{row['name']}-{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as out:
                out.write(row["text"].encode())
            files.move(draft, f"{base}/{row['name']}")
        return WriterCommitMessage()


class GridFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> GridWriter:
        return GridWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it push conditions down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridFiles)


def read_grids(spark: SparkSession, folder: str, variable: str, time_unit: str = "hours") -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("variable", variable).option("time_unit", time_unit).load(folder)


def write_files(texts: DataFrame, folder: str) -> None:
    """Rows (name, text) as files of a folder."""
    register(texts.sparkSession)
    texts.select("name", "text").write.format(FORMAT).mode("append").save(folder)
