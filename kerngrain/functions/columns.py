"""Scalar functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and numbers of the kernel's interfaces and of the record format.
ERRNO = {1: "EPERM", 2: "ENOENT", 6: "ENXIO", 13: "EACCES", 20: "ENOTDIR", 21: "EISDIR", 40: "ELOOP", 101: "ENETUNREACH", 110: "ETIMEDOUT", 111: "ECONNREFUSED", 113: "EHOSTUNREACH"}
ERRNO_BACK = {"ECONNREFUSED": -111, "ETIMEDOUT": -110, "EHOSTUNREACH": -113, "ENETUNREACH": -101}
TCP_STATES = {1: "ESTABLISHED", 2: "SYN_SENT", 3: "SYN_RECV", 4: "FIN_WAIT1", 5: "FIN_WAIT2", 6: "TIME_WAIT", 7: "CLOSE", 8: "CLOSE_WAIT", 9: "LAST_ACK", 10: "LISTEN", 11: "CLOSING"}
SEVERITY = {"info": 0, "warning": 1, "error": 2, "critical": 3, "debug": 4}
OUTCOME = {"success": 0, "failure": 1, "unknown": 2, "timeout": 3, "in_progress": 4}
SENSITIVE_PATHS = ("/var/run/secrets/", "/run/secrets/", "/etc/shadow", "/etc/kubernetes/", "/root/.ssh/", "/home/*/.ssh/")
CATEGORIES = (("kernel.oom", "resource_exhaustion"), ("container.oom", "resource_exhaustion"), ("node.memory_pressure", "resource_exhaustion"), ("node.disk_pressure", "resource_exhaustion"), ("node.cpu_pressure", "resource_exhaustion"), ("pod.restart", "lifecycle"), ("pod.scheduled", "lifecycle"), ("pod.failed", "lifecycle"), ("container.terminated", "lifecycle"), ("container.started", "lifecycle"), ("network.", "network"), ("deployment.", "config_change"), ("config.", "config_change"), ("service.", "service_degradation"), ("scheduling.", "scaling"), ("node.not_ready", "scaling"), ("hpa.", "scaling"), ("security.", "security"), ("policy.", "security"), ("agent.", "self_observability"))
ENRICHMENT = ("raw", "entity_resolved", "context_enriched", "causality_scored", "fully_enriched")


def lookup(values: dict, key: Column) -> Column:
    """The value of a fixed table, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def errno_name(ret: Column) -> Column:
    """The name of an error by its negative or positive number, else E<number>."""
    n = F.abs(ret.cast("int"))
    return F.coalesce(lookup(ERRNO, n), F.concat(F.lit("E"), n.cast("string")))


def errno_number(name: Column) -> Column:
    """The negative number of four names; E<number>; else -1."""
    digits = F.regexp_extract(name, r"^E([0-9]+)$", 1)
    return F.coalesce(lookup(ERRNO_BACK, name), -F.when(digits != "", digits).try_cast("int"), F.lit(-1))


def tcp_state_name(code: Column) -> Column:
    """1 to 11, else UNKNOWN."""
    return F.coalesce(lookup(TCP_STATES, code.cast("int")), F.lit("UNKNOWN"))


def tcp_state_code(name: Column) -> Column:
    """The number of a name, else 0."""
    return F.coalesce(lookup({v: k for k, v in TCP_STATES.items()}, name), F.lit(0))


def c_string(text: Column) -> Column:
    """E5: up to the first NUL."""
    return F.substring_index(text, "\0", 1)


def hex_text(data: Column) -> Column:
    """E6."""
    return F.lower(F.hex(data))


def connection_id(src_ip: str = "src_ip", src_port: str = "src_port", dst_ip: str = "dst_ip", dst_port: str = "dst_port") -> Column:
    """Src:port->dst:port."""
    return F.concat(F.col(src_ip), F.lit(":"), F.col(src_port), F.lit("->"), F.col(dst_ip), F.lit(":"), F.col(dst_port))


def container_of_path(path: Column) -> Column:
    """Runtime and id of the container that a cgroup path names, from its last segment back.

    A segment with a runtime's prefix ends the search, even if its id isn't 64 hexadecimal digits: then null. A bare id is
    Docker's below a docker segment, else containerd's.
    """
    known = r"^(cri-containerd|crio|docker)-"
    segment = F.get(F.filter(F.reverse(F.split(path, "/")), lambda x: x.rlike(known) | x.rlike("^[0-9a-fA-F]{64}$")), 0)
    prefix = F.regexp_extract(segment, known, 1)
    ident = F.regexp_replace(F.regexp_replace(segment, known, ""), r"\.scope$", "")
    runtime = F.when(prefix == "cri-containerd", "containerd").when(prefix == "crio", "cri-o").when(prefix == "docker", "docker").when(path.contains("/docker/"), "docker").otherwise("containerd")
    return F.when(ident.rlike("^[0-9a-fA-F]{64}$"), F.struct(runtime.alias("runtime"), F.lower(ident).alias("id")))


def container_of_uri(uri: Column) -> Column:
    """Scheme://id; an unknown scheme or none is containerd; null unless the id is 64 hexadecimal digits."""
    scheme, ident = F.regexp_extract(uri, "^([a-z-]+)://", 1), F.regexp_replace(uri, "^[a-z-]+://", "")
    runtime = F.when(scheme.isin("docker", "cri-o"), scheme).otherwise("containerd")
    return F.when(ident.rlike("^[0-9a-fA-F]{64}$"), F.struct(runtime.alias("runtime"), F.lower(ident).alias("id")))


def boot_id(text: Column) -> Column:
    """A UUID in lower case, else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lower(text))


def controlling_owner(owners: Column) -> Column:
    """The first owner with controller set; null if its kind, name or uid is blank."""
    x = F.get(F.filter(owners, lambda o: F.coalesce(o["controller"], F.lit(False))), 0)
    return F.when((F.trim(x["kind"]) != "") & (F.trim(x["name"]) != "") & (F.trim(x["uid"]) != ""), x)


def parse_patterns(text: str) -> list[str]:
    """Comma-separated, trimmed, blanks left out; the defaults if none is left."""
    return [x.strip() for x in text.split(",") if x.strip()] or list(SENSITIVE_PATHS)


def severity_code(name: Column) -> Column:
    """E13."""
    return lookup(SEVERITY, name)


def outcome_code(name: Column) -> Column:
    """E13; null is unknown."""
    return F.coalesce(lookup(OUTCOME, name), F.lit(2))


def function_of_source(source: Column) -> Column:
    """What follows the agent's name."""
    return F.regexp_replace(source, "^[^/]*/", "")


def endpoint(ip: Column, port: Column) -> Column:
    """Ip:port, null without an address."""
    return F.when(ip.isNotNull(), F.concat_ws(":", ip, port))


def rfc3339(at: Column) -> Column:
    """E17."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def record_id(observed_at_ns: Column, *parts: Column) -> Column:
    """Sortable by time and the same at each replay: milliseconds, then a digest of what identifies the record."""
    ms = F.lpad(F.call_function("div", observed_at_ns, F.lit(1_000_000)).cast("string"), 15, "0")
    return F.concat(ms, F.lit("-"), F.substring(F.sha2(F.concat_ws("~", *parts), 256), 1, 16))


def category(kind: Column) -> Column:
    """The category of the first prefix that a type begins with, else null."""
    return F.coalesce(*[F.when(kind.startswith(p), c) for p, c in CATEGORIES])


def type_domain(kind: Column) -> Column:
    """Before the first dot."""
    return F.split_part(kind, F.lit("."), F.lit(1))


def type_action(kind: Column) -> Column:
    """After the first dot, else empty."""
    return F.regexp_extract(kind, r"^[^.]*\.(.*)$", 1)


def next_enrichment(state: Column) -> Column:
    """P10: the state after; the last stays."""
    return lookup(dict(zip(ENRICHMENT, (*ENRICHMENT[1:], ENRICHMENT[-1]), strict=True)), state)


def evidence_class(kind: Column) -> Column:
    """Close and retransmit are reliability, all else attribution."""
    return F.when(kind.isin("kernel.tcp.close", "kernel.tcp.retransmit"), "reliability").otherwise("attribution")


def path_pattern(pattern: str) -> str:
    """a pattern as a regular expression. * is any run, slashes too, ? one character; a trailing slash takes what is below."""
    if pattern.endswith("/"):
        pattern += "*"
    return "(?s)^" + "".join(".*" if x == "*" else "." if x == "?" else re.escape(x) for x in pattern) + "$"


def matches_path(path: Column, patterns: list[str] | tuple[str, ...] = SENSITIVE_PATHS) -> Column:
    """F2 behind F3: the cheap prefixes first, which reach the scan, then the whole patterns."""
    coarse = [path.startswith(re.split(r"[*?]", p)[0] or "/") for p in patterns]
    exact = [path.rlike(path_pattern(p)) for p in patterns]
    return reduce(Column.__or__, coarse) & reduce(Column.__or__, exact)
