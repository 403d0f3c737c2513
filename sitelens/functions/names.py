"""Names: files, cameras, capture times, phrases and classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens import constants as C


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With the point, in the file's own case; empty without one."""
    return F.regexp_extract(file_name(path), r"[^.](\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=[^.])\.[^.]*$", "")


def is_image(path: Column, extensions: list[str], either_case: bool = False) -> Column:
    """``either_case``: wholly lower or wholly upper case."""
    ends = F.regexp_extract(file_name(path), r"\.([^.]+)$", 1)
    return ends.isin(extensions + [e.upper() for e in extensions]) if either_case else F.lower(ends).isin(extensions)


def setup_of(name: Column) -> Column:
    """``setup_N`` by the first camera number in a file name; null without one."""
    n = F.regexp_extract(F.lower(name), r"(?:kamera|setup_?|cam)(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("setup_"), n))


def setup_by_substring(name: Column) -> Column:
    """Only the first two cameras, by substring."""
    low = F.lower(name)
    has = lambda n: low.contains(f"kamera{n}") | low.contains(f"setup_{n}") | low.contains(f"setup{n}")
    return F.when(has(1), F.lit("setup_1")).when(has(2), F.lit("setup_2"))


def captured_at(name: Column) -> Column:
    """Time of the last ``_`` part of a file name without .jpg, .jpeg, .png; null if it is none of 14 digits."""
    bare = reduce(lambda c, e: F.replace(c, F.lit(e), F.lit("")), (".jpg", ".jpeg", ".png"), name)
    last = F.substring_index(bare, "_", -1)
    return F.when(last.rlike(r"^\d{14}$"), F.try_to_timestamp(last, F.lit("yyyyMMddHHmmss"))).cast("timestamp_ntz")


def time_label(name: Column) -> Column:
    """``YYYY-MM-DD  HH:MM:SS`` of a stem's last part of 14 digits, whatever the calendar says; null otherwise."""
    d = F.substring_index(stem(name), "_", -1)
    cut = lambda i, n: F.substring(d, i, n)
    return F.when(d.rlike(r"^\d{14}$"), F.concat(cut(1, 4), F.lit("-"), cut(5, 2), F.lit("-"), cut(7, 2), F.lit("  "), cut(9, 2), F.lit(":"), cut(11, 2), F.lit(":"), cut(13, 2)))


def hour_bucket(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HH")


def _first(cases: list[tuple[Column, str]], default: str | None = None) -> Column:
    out = F.when(cases[0][0], F.lit(cases[0][1]))
    for test, value in cases[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def by_length(table: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Longest key first; equal lengths keep their order."""
    return sorted(table, key=lambda x: -len(x[0]))


def phrase_class(phrase: Column) -> Column:
    """Class of a grounded phrase: the longest key inside of it; null without one."""
    clean = F.trim(F.lower(phrase))
    return _first([(clean.contains(k), v) for k, v in by_length(C.PHRASES)])


def phrase_class_module(phrase: Column) -> Column:
    """Class by the older table: the first key that holds the phrase or is held by it."""
    clean = F.trim(F.lower(phrase))
    return _first([(clean.contains(k) | F.lit(k).contains(clean), v) for k, v in C.MODULE_PHRASES], C.MODULE_PHRASE_DEFAULT)


def content_type(phrase: Column) -> Column:
    clean = F.lower(F.trim(phrase))
    return _first([(clean.contains(k), v) for k, v in by_length(C.CONTENT_TYPES)], "other")


def is_logo(phrase: Column) -> Column:
    clean = F.lower(F.trim(phrase))
    return F.when(reduce(lambda a, b: a | b, (clean.contains(k) for k in C.LOGO_PHRASES)), "yes").otherwise("no")


def open_vocabulary_class(name: Column) -> Column:
    low = F.lower(name)
    return _first([(reduce(lambda a, b: a | b, (low.contains(k) for k in keys)), v) for v, keys in C.OPEN_VOCABULARY])


def lookup(key: Column, table: dict) -> Column:
    """A value by a small literal map; null for other keys."""
    items = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*items), key)


def class_name(class_id: Column) -> Column:
    """The class's name, ``class_<id>`` beyond the list."""
    names = F.array(*map(F.lit, C.CLASS_NAMES))
    return F.when(class_id.between(0, len(C.CLASS_NAMES) - 1), F.get(names, class_id)).otherwise(F.concat(F.lit("class_"), class_id.cast("string")))


def class_id(name: Column) -> Column:
    return lookup(name, C.CLASS_IDS)


def coco_class(number: Column, module: bool = False) -> Column:
    return lookup(number, C.COCO_CLASSES_MODULE if module else C.COCO_CLASSES)


def global_class(name: Column, number: Column, names: list[str] = C.CLASS_NAMES) -> Column:
    """A model's class by name, else by its number if that is one of ours; null otherwise."""
    ids = lookup(name, {n: i for i, n in enumerate(names)})
    return F.coalesce(ids, F.when(number.between(0, len(names) - 1), number))


def visibility(confidence: Column) -> Column:
    return F.when(confidence >= 0.15, "clear").when(confidence >= 0.08, "partial").otherwise("occluded")


def min_area(name: Column) -> Column:
    return F.coalesce(lookup(name, C.MIN_AREA), F.lit(C.DEFAULT_MIN_AREA))


def min_confidence(name: Column) -> Column:
    return F.coalesce(lookup(name, C.MIN_CONFIDENCE), F.lit(C.DEFAULT_MIN_CONFIDENCE))
