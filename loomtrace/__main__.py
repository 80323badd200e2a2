"""python -m loomtrace [--list | FUNCTION [--argument value ...] [output]]"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from loomtrace.functions import registry


def main(args: list[str]) -> int:
    if not args or args[0] in ("--list", "--help"):
        for n, f in sorted(registry.functions().items()):
            print(f"{n}({', '.join(f.parameters)})  {f.doc}")
        return 0
    name, rest = args[0], args[1:]
    if name not in registry.functions():
        print(f"no function {name}", file=sys.stderr)
        return 2
    arguments, output = {}, None
    while rest:
        if rest[0].startswith("--"):
            if len(rest) < 2:
                print(f"{rest[0]} lacks a value", file=sys.stderr)
                return 2
            arguments[rest[0][2:].replace("-", "_")] = rest[1]
            rest = rest[2:]
        else:
            output, rest = rest[0], rest[1:]
    spark = SparkSession.builder.appName("loomtrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = registry.call(spark, name, arguments)
    if output and hasattr(result, "write"):
        result.write.mode("overwrite").parquet(output)
    elif output:
        with open(output, "w", encoding="utf-8") as f:
            json.dump(registry.plain(result), f, ensure_ascii=False, default=str)
    else:
        print(json.dumps(registry.plain(result), ensure_ascii=False, default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
