"""SQL fragments in two dialects, so that a rule is stated once and runs on Spark and on the checking engine."""

from __future__ import annotations

#: Unicode white space for regular expressions; the last class also has the separators 1c-1f.
DUCK_WS = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Spark:
    name = "spark"
    space = r"(?U)[\s\x1c-\x1f]"

    def text(self, s: str) -> str:
        return 'r"' + s + '"' if "\\" in s or "'" in s else "'" + s + "'"

    def words(self, items) -> str:
        return "array(" + ", ".join('"' + i + '"' if "'" in i else "'" + i + "'" for i in items) + ")"

    def find_all(self, s: str, rx: str) -> str:
        return f"regexp_extract_all({s}, {self.text(rx)}, 0)"

    def group(self, s: str, rx: str, i: int = 1) -> str:
        return f"regexp_extract({s}, {self.text(rx)}, {i})"

    def replace(self, s: str, rx: str, to: str = "") -> str:
        return f"regexp_replace({s}, {self.text(rx)}, '{to}')"

    def like(self, s: str, rx: str) -> str:
        return f"rlike({s}, {self.text(rx)})"

    def filter(self, a: str, x: str, c: str) -> str:
        return f"filter({a}, {x} -> {c})"

    def map(self, a: str, x: str, e: str) -> str:
        return f"transform({a}, {x} -> {e})"

    def any(self, a: str, x: str, c: str) -> str:
        return f"exists({a}, {x} -> {c})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as int)"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def has(self, a: str, v: str) -> str:
        return f"array_contains({a}, {v})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"array_union({a}, {b})"

    def minus(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def slice(self, a: str, lo: str, n: str) -> str:
        return f"slice({a}, {lo}, {n})"

    def range(self, lo: str, hi: str) -> str:
        """lo..hi, empty when hi < lo."""
        return f"(CASE WHEN {hi} >= {lo} THEN sequence({lo}, {hi}) ELSE array() END)"

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, {i})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {quote(sep)})"

    def sort(self, a: str) -> str:
        return f"sort_array({a})"

    def least_of(self, a: str) -> str:
        return f"array_min({a})"

    def sentences(self, t: str) -> str:
        return f'split({t}, r"(?U)(?<=[.!?])[\\s\\x1c-\\x1f]+", -1)'

    def split(self, t: str, sep: str) -> str:
        return f"split({t}, {self.text(sep)}, -1)"

    def collapse(self, t: str) -> str:
        return f"trim(regexp_replace({t}, r'{self.space}+', ' '))"

    def strip(self, t: str) -> str:
        return self.replace(t, f"^{self.space}+|{self.space}+$")

    def explode(self, a: str) -> str:
        return f"explode({a})"

    def compact(self, items: list[str]) -> str:
        return f"array_compact(array({', '.join(items)}))"

    def sha(self, t: str) -> str:
        return f"sha2({t}, 256)"

    def divide(self, a: str, b: str) -> str:
        return f"try_divide(cast({a} as double), cast({b} as double))"

    def count_in(self, hay: str, needle: str) -> str:
        return f"(length({hay}) - length(replace({hay}, '{needle}', '')))"

    def lists(self, table: str, columns: str, array: str, alias: str, position: str | None = None) -> str:
        """FROM clause that makes a row of each element (and its place from 0)."""
        if position:
            return f"(SELECT {columns}, {position}, {alias} FROM {table} LATERAL VIEW posexplode({array}) e AS {position}, {alias})"
        return f"(SELECT {columns}, {alias} FROM {table} LATERAL VIEW explode({array}) e AS {alias})"


class Duck(Spark):
    name = "duck"
    space = f"[{DUCK_WS}]"

    def text(self, s: str) -> str:
        return quote(s)

    def words(self, items) -> str:
        return "[" + ", ".join(quote(i) for i in items) + "]"

    def find_all(self, s: str, rx: str) -> str:
        return f"regexp_extract_all({s}, {quote(rx)})"

    def replace(self, s: str, rx: str, to: str = "") -> str:
        return f"regexp_replace({s}, {quote(rx)}, '{to}', 'g')"

    def like(self, s: str, rx: str) -> str:
        return f"regexp_matches({s}, {quote(rx)})"

    def filter(self, a: str, x: str, c: str) -> str:
        return f"list_filter({a}, lambda {x}: {c})"

    def map(self, a: str, x: str, e: str) -> str:
        return f"list_transform({a}, lambda {x}: {e})"

    def any(self, a: str, x: str, c: str) -> str:
        return f"(len(list_filter({a}, lambda {x}: {c})) > 0)"

    def size(self, a: str) -> str:
        return f"len({a})::INT"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"

    def has(self, a: str, v: str) -> str:
        return f"list_contains({a}, {v})"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def union(self, a: str, b: str) -> str:
        return f"list_distinct(list_concat({a}, {b}))"

    def minus(self, a: str, b: str) -> str:
        return f"list_distinct(list_filter({a}, lambda zz: NOT list_contains({b}, zz)))"

    def slice(self, a: str, lo: str, n: str) -> str:
        return f"list_slice({a}, {lo}, ({lo}) + ({n}) - 1)"

    def range(self, lo: str, hi: str) -> str:
        return f"range({lo}, ({hi}) + 1)"

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {quote(sep)})"

    def sort(self, a: str) -> str:
        return f"list_sort({a})"

    def least_of(self, a: str) -> str:
        return f"list_min({a})"

    def sentences(self, t: str) -> str:
        return f"string_split(regexp_replace({t}, '([.!?])[{DUCK_WS}]+', '\\1' || chr(1), 'g'), chr(1))"

    def split(self, t: str, sep: str) -> str:
        return f"string_split({t}, {quote(sep.replace(chr(92), ''))})"

    def collapse(self, t: str) -> str:
        return f"trim(regexp_replace({t}, '[{DUCK_WS}]+', ' ', 'g'))"

    def explode(self, a: str) -> str:
        return f"unnest({a})"

    def compact(self, items: list[str]) -> str:
        return f"list_filter([{', '.join(items)}], lambda cc: cc IS NOT NULL)"

    def sha(self, t: str) -> str:
        return f"sha256({t})"

    def divide(self, a: str, b: str) -> str:
        return f"(({a})::DOUBLE / nullif(({b})::DOUBLE, 0))"

    def lists(self, table: str, columns: str, array: str, alias: str, position: str | None = None) -> str:
        if position:
            return f"(SELECT {columns}, (generate_subscripts({array}, 1) - 1)::INT AS {position}, unnest({array}) AS {alias} FROM {table})"
        return f"(SELECT {columns}, unnest({array}) AS {alias} FROM {table})"


SPARK, DUCK = Spark(), Duck()
