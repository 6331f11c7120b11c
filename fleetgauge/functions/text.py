"""Name patterns and structured item keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the monitoring templates name and key the items. The two
# size keys are compared for equality, the percent sign in them is literal.
USED_NAME = "%VMware: Used disk space on %"
FREE_NAME = "%VMware: Free disk space on %"
USED_KEY = "vmware.vm.vfs.fs.size[{$VMWARE.URL},{$VMWARE.VM.UUID},%,used]"
FREE_KEY = "vmware.vm.vfs.fs.size[{$VMWARE.URL},{$VMWARE.VM.UUID},%,free]"
POWER_KEY = "vmware.vm.powerstate[{$VMWARE.URL},{$VMWARE.VM.UUID}]"
SIZE_KEY_REGEX = (
    r"^vmware\.vm\.vfs\.fs\.size\[\{\$VMWARE\.URL\},\{\$VMWARE\.VM\.UUID\},.+,(used|free)\]$"
)


def matches_none(text: Column, patterns: tuple[str, ...]) -> Column:
    """True when ``text`` is LIKE none of ``patterns``."""
    return reduce(lambda found, p: found & ~text.like(p), patterns, F.lit(True))


def filesystem(key: Column, side: str) -> Column:
    """Filesystem named in an item key.

    The text before the first ``,<side>``, then after the last ``},``; a key
    without ``},`` gives its whole prefix.
    """
    return F.substring_index(F.substring_index(key, f",{side}", 1), "},", -1)
