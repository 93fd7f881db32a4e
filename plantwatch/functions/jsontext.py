"""JSON inside text: finding it, parsing it, comparing it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantwatch.functions.texts import let, strip

FENCE = "`" * 3
END_MARK = "plantwatch: end of answer"


def _before_last(text: Column, mark: str) -> Column:
    """Text in front of the last mark; the whole text where there is none."""
    kept = F.length(text) - F.length(F.substring_index(text, mark, -1)) - len(mark)
    return F.when(F.contains(text, F.lit(mark)), F.left(text, kept)).otherwise(text)


def _unfenced(body: Column) -> Column:
    """Text without the line of an opening fence and without the closing fence and its tail."""
    line_end = F.instr(body, "\n")
    below = F.when(line_end > 0, F.substring(body, line_end + 1, F.length(body))).otherwise(body)
    inner = let(below, lambda text: _before_last(text, FENCE))
    return F.when(F.startswith(body, F.lit(FENCE)), inner).otherwise(body)


def _braced(body: Column) -> Column:
    tail = F.substring(body, F.instr(body, "{"), F.length(body))
    span = let(tail, lambda text: F.left(text, F.length(text) - F.length(F.substring_index(text, "}", -1))))
    return F.when(F.contains(body, F.lit("{")), F.nullif(span, F.lit("")))


def json_span(text: Column) -> Column:
    """Text from the first "{" to the last "}", after a surrounding code fence is taken off.

    Plain searches only: the work is linear in the length of the text, whatever it holds.
    """
    return let(let(strip(text), _unfenced), _braced)


def extract_json(text: Column) -> Column:
    """VARIANT of the JSON object in a model answer; NULL where there is none that parses.

    The whole span must be one object. An object that names a key twice does not parse.
    """
    # The parser stops after a complete value and would overlook what follows. Inside an array the
    # span must be exactly the first element, with the mark after it.
    marked = F.try_parse_json(F.concat(F.lit("["), json_span(text), F.lit(f',"{END_MARK}"]')))

    def whole(value: Column) -> Column:
        ends = F.try_variant_get(value, "$[1]", "string") == END_MARK
        return F.when(ends, F.try_variant_get(value, "$[0]", "variant"))

    return let(marked, whole)


def _json_value(value: Column) -> Column:
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def label_json(fields: Sequence[str]) -> Column:
    """JSON text of the named columns in their order, with a blank after colons and commas."""
    members = [F.concat(F.lit(f'"{name}": '), _json_value(F.col(name))) for name in fields]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def _member(value: Column, field: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", "variant")


def has_field(value: Column, field: str) -> Column:
    return _member(value, field).isNotNull()


def _comparable(value: Column) -> Column:
    """Text equal for equal JSON values: 1, 1.0 and true agree, "true" and true do not."""

    def canonical(text: Column) -> Column:
        flag = F.when(text == "true", "1").when(text == "false", "0").otherwise(text)
        # Only a bare number casts; a JSON string keeps its quotes. Whole numbers compare exactly, also beyond 2^53.
        number = flag.try_cast("double")
        exact = flag.try_cast("decimal(38,0)")
        whole = F.when(flag.rlike(r"^-?\d+$") | ((number == F.floor(number)) & (F.abs(number) < 2.0**53)), exact.cast("string"))
        return F.coalesce(whole, (number + F.lit(0.0)).cast("string"), text)

    return let(F.to_json(value), canonical)


def same_field(left: Column, right: Column, field: str) -> Column:
    """1 where both hold the field with equal values, else 0."""
    same = _comparable(_member(left, field)) == _comparable(_member(right, field))
    return F.coalesce(same.cast("int"), F.lit(0))


def field_text(value: Column, field: str) -> Column:
    """Member as plain text; NULL where missing."""
    member = _member(value, field)
    return F.coalesce(F.try_variant_get(value, f"$.{field}", "string"), F.to_json(member))
