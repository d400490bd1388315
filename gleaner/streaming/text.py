"""Structured Streaming over lines and JSON lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleaner.operators.buffers import MAX_LINES, line_form
from gleaner.operators.extract import spans
from gleaner.operators.replace import anonymized_text, json_anonymized

#: State of this kind is kept in changed entries, not rewritten whole.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def lines(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of the lines of text files that arrive in ``folder``."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)


def detected(stream: DataFrame, text: str, names: list[str] | None = None) -> DataFrame:
    """(text, pattern_name, matched_text): findings of each line; stateless."""
    return stream.select(text, F.explode(spans(text, names)).alias("f")).select(text, "f.pattern_name", "f.matched_text")


def counted(stream: DataFrame, text: str, names: list[str] | None = None) -> DataFrame:
    """Running counts by pattern, for complete or update mode."""
    return detected(stream, text, names).groupBy("pattern_name").agg(F.count("*").alias("n"))


def anonymized(stream: DataFrame, text: str, secret: bytes, names: list[str] | None = None) -> DataFrame:
    """Every line with its findings replaced by keyed placeholders; stateless, so equal values agree everywhere without order."""
    return anonymized_text(stream, text, "corpus", secret, names)


def json_lines(stream: DataFrame, text: str, secret: bytes, names: list[str] | None = None) -> DataFrame:
    """JSON lines without blank ones, one compact record a line, values anonymized.

    A record that is no JSON ends the query without showing its text.
    """
    good = F.assert_true(F.try_parse_json(text).isNotNull(), F.lit("a record is not valid JSON")).isNull()
    return json_anonymized(stream.filter(F.trim(text) != "").filter(good), text, "corpus", secret, names, compact=True)


class _Numbers(StatefulProcessor):
    """Numbers of one session's values: one entry of the state a value, and the last number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "value string", "number int")
        self.last = handle.getValueState("last", "number int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.last.get()
        last = first = before[0] if before else 0
        fresh: dict[str, int] = {}
        for r in rows:
            v = r["value"]
            if v is None:
                continue
            n = fresh.get(v)
            if n is None:
                if self.numbers.containsKey((v,)):
                    n = self.numbers.getValue((v,))[0]
                else:
                    n = last = last + 1
                    self.numbers.updateValue((v,), (n,))
                fresh[v] = n
            yield Row(session=key[0], value=v, number=n)
        if last != first:
            self.last.update((last,))

    def close(self) -> None:
        pass


def numbered(values: DataFrame) -> DataFrame:
    """(session, value, number): values numbered by first arrival within their session, in state kept by session.

    The state is a map, so a batch writes the new values only.  Null values are left out.  Needs the state store of STORE.
    """
    return values.groupBy("session").transformWithState(_Numbers(), "session string, value string, number int", "append", "None")


class _Sentences(StatefulProcessor):
    """The open sentence of one source: its lines so far, and the number of the last unit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "line string")
        self.unit = handle.getValueState("unit", "number int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [r[0] for r in self.open.get()]
        at = self.unit.get()
        unit = at[0] if at else 0
        # the lines of one source that arrive together; their order is the source's
        for r in sorted(rows, key=lambda r: r["line_no"]):
            prose = r["form"] == "prose"
            if held and not prose:
                unit += 1
                yield Row(key=key[0], unit=unit, text=" ".join(held))
                held = []
            if prose:
                held.append(r["line"].strip(" "))
                if not (r["ends"] or r["last"] or len(held) >= MAX_LINES):
                    continue
            elif r["form"] != "empty":
                held = [r["line"].strip(" ")]
            if held:
                unit += 1
                yield Row(key=key[0], unit=unit, text=" ".join(held))
                held = []
        self.unit.update((unit,))
        if held:
            self.open.put([(h,) for h in held])
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def sentence_units(stream: DataFrame, key: str, order: str, line: str, last: str) -> DataFrame:
    """T4: (key, unit, text): a stream's lines buffered into sentences for a recogniser.

    The state of a source is its open sentence, at most MAX_LINES lines.  A line marked ``last`` closes its source.
    Needs the state store of STORE.
    """
    d = stream.select(F.col(key).alias("key"), F.col(order).alias("line_no"), F.col(line).alias("line"), F.col(last).alias("last"), line_form(F.col(line)).alias("form"), F.col(line).rlike(r"[.!?]\s*$").alias("ends"))
    kind = stream.schema[key].dataType.simpleString()
    return d.groupBy("key").transformWithState(_Sentences(), f"key {kind}, unit int, text string", "append", "None")


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Beyond the line streams: event counts in tumbling windows with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
