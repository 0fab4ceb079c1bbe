"""Tables in the shared folder, and the driver's memory while they are made."""

import re
from pathlib import Path

from burrow.store import Tables


def held(pid="self"):
    """MB that a process holds."""
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_memory_that_the_driver_freed_goes_back(spark):
    """Blocks that lie below one still in use, in Python and in the JVM."""
    tables, jvm = Tables(spark), spark._jvm
    tables.add(spark.range(10))
    pid = jvm.java.lang.ProcessHandle.current().pid()
    blocks = [bytearray(b"x") * 100_000 for _ in range(1000)]
    packers = [jvm.java.util.zip.Deflater() for _ in range(3000)]
    for p in packers[:-1]:
        p.end()
    del blocks[:-1]
    python, java = held(), held(pid)
    assert tables.add(spark.range(10)).count() == 10
    assert held() < python - 50 and held(pid) < java - 40
    packers[-1].end()
    tables.clear()
