"""Load numbers of the landing log: each (stream, batch) has one of its own, whatever other streams do.

A number is taken by creating an empty file that must not exist yet, so two streams that run at the
same time, or in turns, can't get the same one. The file ``streams/<stream>/<batch>=<number>`` then
names the number, and a replayed batch finds it there. A writer that dies in between leaves a number
that nothing uses. Numbers grow in the order in which loads begin.

The file system must refuse to create a file that exists, as HDFS does. A local disk looks first and
creates then; streams of one driver take numbers one after another.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone
from threading import Lock

from pyspark.sql import SparkSession

from wirepulse.sources.folders import Folder

_ONE_AT_A_TIME = Lock()
_LOST_AFTER = 3600


@dataclass(frozen=True)
class Load:
    number: int
    reserved_at: datetime  # UTC, without a zone; the same for a replayed batch


class LoadManifest:
    """The numbers of a landing log, kept below ``<landing path>/_loads``."""

    def __init__(self, spark: SparkSession, landing_path: str):
        self._log = Folder(spark, landing_path)

    def reserve(self, stream: str, batch: int) -> Load:
        """The number of a batch: the one it has already, or the next free one."""
        own = self._number_of(stream, batch)
        if own is None:
            own = self._take()
            self._log.create(f"_loads/streams/{stream}/{batch}={own}")
            own = self._number_of(stream, batch)
        named = self._log.modified(f"_loads/streams/{stream}/{batch}={own}")
        moment = datetime.fromtimestamp(named / 1000, timezone.utc)
        return Load(own, moment.replace(tzinfo=None))

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self._log.names("_loads/numbers/*"))

    def finish(self, load: Load) -> None:
        """Says that all rows of a load are written; again for a replayed batch."""
        self._log.create(f"_loads/finished/{load.number}")

    def finished_through(self) -> int:
        """The largest number up to which no load is still to come, or -1. A batch that has its number
        but didn't finish will be replayed; a number without a batch is given up after an hour."""
        named = {int(n.split("=")[1]) for n in self._log.names("_loads/streams/*/*=*")}
        finished = {int(n) for n in self._log.names("_loads/finished/*")}
        numbers = self.numbers()
        if not numbers:  # written without the manifest, one load after another
            return max((int(n.split("=")[1]) for n in self._log.names("load_seq=*")), default=-1)
        through = numbers[0] - 1
        for n in numbers:
            lost = n not in named and self._log.modified(f"_loads/numbers/{n}") < (time.time() - _LOST_AFTER) * 1000
            if n not in finished and not lost:
                break
            through = n
        return through

    def _number_of(self, stream: str, batch: int) -> int | None:
        found = [int(n.split("=")[1]) for n in self._log.names(f"_loads/streams/{stream}/{batch}=*")]
        return min(found, default=None)

    def _take(self) -> int:
        taken = self.numbers()
        if not taken:  # a log from before there were numbers
            taken = [int(n.split("=")[1]) for n in self._log.names("load_seq=*")]
        number = max(taken, default=-1) + 1
        with _ONE_AT_A_TIME:
            while not self._log.create(f"_loads/numbers/{number}"):
                number += 1
        return number
