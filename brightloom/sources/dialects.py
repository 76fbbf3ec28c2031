"""Expressions of the generators as SQL text, for Spark and for an engine that checks it.

A value is a function of a table's column and a row's key alone, so any partitioning gives the same rows and pruned
columns cost nothing.
"""

from __future__ import annotations

import zlib

#: 2^31 - 1.
PRIME = 2147483647


class Spark:
    def draw(self, stream: str, key: str = "id") -> str:
        """A number from 0 to 2^31 - 2: the key, moved by the stream's constants, through two quadratic rounds modulo a prime.

        All steps stay within 63 bits and are plain arithmetic in either engine; a linear step alone would leave
        neighbouring keys related.
        """
        a, b, c, d = (zlib.crc32(f"{stream}/{i}".encode()) % (PRIME - 1) + 1 for i in range(4))
        x = f"((({key}) % {PRIME} * {a} + {b}) % {PRIME})"
        y = f"({x} * ({x} + {c}) % {PRIME})"
        return f"({y} * ({y} + {d}) % {PRIME})"

    def pick(self, values: list[str], index: str) -> str:
        return f"element_at(array({', '.join(map(self.text, values))}), cast({index} as int) + 1)"

    def day(self, n: str, first: str = "1992-01-01") -> str:
        return f"date_format(date_add(date'{first}', cast({n} as int)), 'yyyy-MM-dd')"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))"

    def hash(self, stream: str, key: str = "id") -> str:
        return f"md5(concat(cast({key} as string), ':{stream}'))"

    def rows(self, n: int, first: int = 1) -> str:
        return f"(select id from range({first}, {first + n}))"

    def children(self, parents: str, count: str) -> str:
        return f"(select *, explode(sequence(1, cast({count} as int))) as line from {parents})"

    def part(self, what: str, n: str, first: str = "1900-01-02") -> str:
        d = f"date_add(date'{first}', cast({n} as int))"
        return {"year": f"year({d})", "month": f"month({d})", "day": f"day({d})", "quarter": f"quarter({d})", "dow": f"(dayofweek({d}) - 1)"}[what]

    def month_end(self, n: str, first: str = "1900-01-02") -> str:
        return f"day(last_day(date_add(date'{first}', cast({n} as int))))"

    @staticmethod
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"


class Duck(Spark):
    def pick(self, values: list[str], index: str) -> str:
        return f"list_extract([{', '.join(map(self.text, values))}], cast({index} as int) + 1)"

    def day(self, n: str, first: str = "1992-01-01") -> str:
        return f"strftime(date '{first}' + cast({n} as int), '%Y-%m-%d')"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))"

    def hash(self, stream: str, key: str = "id") -> str:
        return f"md5(concat(cast({key} as varchar), ':{stream}'))"

    def rows(self, n: int, first: int = 1) -> str:
        return f"(select range as id from range({first}, {first + n}))"

    def children(self, parents: str, count: str) -> str:
        return f"(select *, unnest(range(1, cast({count} as bigint) + 1)) as line from {parents})"

    def part(self, what: str, n: str, first: str = "1900-01-02") -> str:
        return f"{ {'dow': 'dayofweek'}.get(what, what) }(date '{first}' + cast({n} as int))".replace("{ ", "").replace(" }", "")

    def month_end(self, n: str, first: str = "1900-01-02") -> str:
        return f"day(last_day(date '{first}' + cast({n} as int)))"
