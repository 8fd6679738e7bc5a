"""What is known of each artifact: where its tool's rows go, what holds their time, what identifies them."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewire.functions.ids import content_id, natural_id, natural_or_content_id, quoted, short_hash
from sedgewire.functions.timeparse import parse_time


class Tool(NamedTuple):
    program: str
    artifact: str
    tier: int
    time: str
    key: tuple[str, ...] = ()
    several: bool = False


# Tools that leave CSV files, the artifact, the tier, the time column and the natural key.
TOOLS = {
    "amcache": Tool("AmcacheParser", "amcache", 1, "FileKeyLastWriteTimestamp", several=True),
    "shimcache": Tool("AppCompatCacheParser", "shimcache", 1, "LastModifiedTimeUTC"),
    "registry": Tool("RECmd", "registry", 1, "LastWriteTimestamp", several=True),
    "shellbags": Tool("SBECmd", "shellbags", 1, "LastInteracted"),
    "evtxecmd": Tool("", "evtx", 1, "TimeCreated"),
    "jumplists": Tool("JLECmd", "jumplists", 2, "LastModified"),
    "lnk": Tool("LECmd", "lnk", 2, "TargetModified"),
    "recyclebin": Tool("RBCmd", "recyclebin", 2, "DeletedOn"),
    "mft": Tool("MFTECmd", "mft", 3, "Created0x10", ("EntryNumber", "SequenceNumber", "FileName", "ParentEntryNumber")),
    "usn": Tool("MFTECmd", "usn", 3, "UpdateTimestamp"),
    "timeline": Tool("WxTCmd", "timeline", 3, "LastModifiedTime"),
}
# Memory plugins by the tier that adds them.
MEMORY_TIERS = {
    1: ("windows.info", "windows.pslist", "windows.pstree", "windows.cmdline", "windows.netstat", "windows.svcscan", "windows.modules", "windows.registry.hivelist"),
    2: ("windows.netscan", "windows.dlllist", "windows.envars", "windows.getsids", "windows.psscan", "windows.ldrmodules", "windows.callbacks", "windows.ssdt", "windows.registry.userassist"),
    3: ("windows.handles", "windows.filescan", "windows.malfind", "windows.shimcachemem", "windows.driverscan", "windows.mutantscan", "timeliner"),
}
# The column that holds the time of a plugin's rows.
MEMORY_TIMES = {
    "windows.pslist": "CreateTime", "windows.pstree": "CreateTime", "windows.psscan": "CreateTime", "windows.netscan": "Created", "windows.netstat": "Created",
    "windows.dlllist": "LoadTime", "windows.registry.userassist": "Last Write Time", "windows.shimcachemem": "LastModified",
}
# The fields that identify a plugin's rows.
MEMORY_KEYS = {
    "windows.pslist": ("PID", "CreateTime"), "windows.pstree": ("PID", "CreateTime"), "windows.netscan": ("LocalAddr", "LocalPort", "ForeignAddr", "ForeignPort", "PID"),
    "windows.netstat": ("LocalAddr", "LocalPort", "ForeignAddr", "ForeignPort", "PID"), "windows.svcscan": ("Name", "PID"), "windows.cmdline": ("PID",), "windows.dlllist": ("PID", "Base", "Name"),
    "windows.handles": ("PID", "Offset(V)"), "windows.modules": ("Base", "Name"), "windows.registry.hivelist": ("Offset(V)",),
}
# The kinds of handles that are kept.
HANDLE_TYPES = ("File", "Key", "Mutant", "Event", "Section", "ALPC Port", "Directory", "SymbolicLink", "Thread", "Process")
# Event ids of the reduced set.
EVENT_IDS = (
    1, 2, 3, 6, 7, 8, 10, 11, 12, 13, 15, 17, 18, 19, 20, 21, 22, 23, 25, 59, 60, 61, 104, 106, 131, 140, 141, 200, 201, 400, 800, 1006, 1007, 1013, 1024, 1102, 1116, 1117, 1118, 1119, 2003, 2004,
    2006, 4103, 4104, 4624, 4625, 4634, 4648, 4672, 4688, 4697, 4698, 4699, 4720, 4722, 4724, 4728, 4732, 4740, 4756, 4768, 4769, 4770, 4771, 4776, 4778, 4779, 5001, 5004, 5007, 5012, 5140, 5145,
    5156, 5158, 5861, 7045,
)
# Event logs of the reduced set; files below the size hold no event.
LEAST_LOG_BYTES = 69_632
LOGS = """
Security
System
Application
Setup
ForwardedEvents
Microsoft-Windows-Sysmon%4Operational
Microsoft-Windows-PowerShell%4Operational
Microsoft-Windows-PowerShell%4Admin
Microsoft-Windows-PowerShell-DesiredStateConfiguration-FileDownloadManager%4Operational
Windows PowerShell
Microsoft-Windows-TerminalServices-LocalSessionManager%4Operational
Microsoft-Windows-TerminalServices-LocalSessionManager%4Admin
Microsoft-Windows-TerminalServices-RemoteConnectionManager%4Operational
Microsoft-Windows-TerminalServices-RemoteConnectionManager%4Admin
Microsoft-Windows-TerminalServices-RDPClient%4Operational
Microsoft-Windows-TerminalServices-SessionBroker-Client%4Operational
Microsoft-Windows-TerminalServices-SessionBroker-Client%4Admin
Microsoft-Windows-RemoteDesktopServices-RdpCoreTS%4Operational
Microsoft-Windows-RemoteDesktopServices-RdpCoreTS%4Admin
Microsoft-Windows-RemoteDesktopServices-SessionServices%4Operational
Microsoft-Windows-SMBClient%4Operational
Microsoft-Windows-SMBServer%4Operational
Microsoft-Windows-SMBServer%4Audit
Microsoft-Windows-SMBServer%4Security
Microsoft-Windows-SMBServer%4Connectivity
Microsoft-Windows-SmbClient%4Audit
Microsoft-Windows-SmbClient%4Connectivity
Microsoft-Windows-SmbClient%4Security
Microsoft-Windows-WinRM%4Operational
Microsoft-Windows-Forwarding%4Operational
Microsoft-Windows-EventCollector%4Operational
OpenSSH%4Operational
OpenSSH%4Admin
Microsoft-Windows-TaskScheduler%4Operational
Microsoft-Windows-WMI-Activity%4Operational
Microsoft-Windows-Regsvr32%4Operational
Microsoft-Windows-Windows Defender%4Operational
Microsoft-Windows-Windows Firewall With Advanced Security%4Firewall
Microsoft-Windows-CodeIntegrity%4Operational
Microsoft-Windows-AppLocker%4EXE and DLL
Microsoft-Windows-AppLocker%4MSI and Script
Microsoft-Windows-AppLocker%4Packaged app-Execution
Microsoft-Windows-SENSE%4Operational
Microsoft-Windows-SenseIR%4Operational
Microsoft-Windows-Security-Mitigations%4KernelMode
Microsoft-Windows-Security-Mitigations%4UserMode
Microsoft-Windows-NTLM%4Operational
Microsoft-Windows-Bits-Client%4Operational
Microsoft-Windows-DNS-Client%4Operational
Microsoft-Windows-TCPIP%4Operational
Microsoft-Windows-Winlogon%4Operational
Microsoft-Windows-User Profile Service%4Operational
Microsoft-Windows-GroupPolicy%4Operational
Microsoft-Windows-Security-Netlogon%4Operational
Microsoft-Windows-Privacy-Auditing%4Operational
Microsoft-Windows-VHDMP-Operational
Microsoft-Windows-PrintService%4Operational
Microsoft-Windows-DriverFrameworks-UserMode%4Operational
"""


def memory_plugins(tier: int) -> list[str]:
    """The plugins of a tier and those below."""
    return [p for k, names in MEMORY_TIERS.items() if k <= tier for p in names]


def sub_table(stem: str) -> str:
    """A CSV file's table: its stem without the number that some tools put before it."""
    return re.sub(r"^\d+_", "", stem)


def reduced_logs(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Event-log files of the reduced set that are long enough to hold events."""
    stem = F.regexp_replace(F.lower(F.regexp_extract(quoted(path), r"[^\\/]*$", 0)), r"\.evtx$", "")
    return files.where(F.replace(stem, F.lit("%20"), F.lit(" ")).isin(*(x.lower() for x in LOGS.strip().splitlines())) & (quoted(length) >= LEAST_LOG_BYTES))


def tool_rows(df: DataFrame, tool: str, index: Column) -> DataFrame:
    """A tool's CSV rows with their time and identity."""
    known = TOOLS[tool]
    ts = parse_time(quoted(known.time)) if known.time in df.columns else F.lit(None).cast("timestamp")
    key = list(known.key) if set(known.key) <= set(df.columns) else []
    out = df.withColumn("index_name", index).withColumn("@timestamp", ts)
    same = natural_or_content_id(F.col("index_name"), key, df.columns) if key else content_id(F.col("index_name"), df.columns)
    return out.withColumn("_id", same)


def with_memory_id(df: DataFrame, index: Column) -> DataFrame:
    """Identity of memory records (plugin, record): the plugin's key where all of it is there, else the whole record."""
    same = short_hash(F.concat_ws("\x1f", index, F.to_json("record")))
    for plugin, names in MEMORY_KEYS.items():
        parts = [F.try_variant_get("record", f"$['{n}']", "string") for n in names]
        whole = F.col("plugin") == plugin
        for p in parts:
            whole = whole & (F.coalesce(p, F.lit("")) != "")
        same = F.when(whole, natural_id(index, *parts)).otherwise(same)
    return df.withColumn("index_name", index).withColumn("_id", same)
