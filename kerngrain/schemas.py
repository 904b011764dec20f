"""Column names and types of kernel events and of the records made from them."""

from __future__ import annotations

SCHEMA_VERSION = "1"
PRODUCER, PRODUCER_VERSION = "kerngrain", "0.1"
CLUSTER = "c1"
#: Fixed value: how a process is told apart for good, by the boot time at which its leader started.
IDENTITY_METHOD = "task_start_boottime_btf_v1"

EVENTS = (
    "event_id long, cluster string, node_id string, boot_id string, observed_at_ns long, event_type string, pid long, cgroup_id long, comm string, "
    "src_ip string, src_port int, dst_ip string, dst_port int, ret int, tcp_state string, bytes_sent long, bytes_received long, "
    "duration_ns long, filename string, path string, uid long, ppid long, flags long, "
    "tid long, gid long, start_boottime_ns long, identity_method string, argv_hash string, path_truncated boolean"
)

#: Field names of the record format.
OCCURRENCE = (
    "id string, timestamp timestamp, source string, type string, severity string, outcome string, correlation_keys array<string>, "
    "error struct<code:string,message:string,possible_causes:array<string>>, entity_ids array<string>, cluster string, namespace string, "
    "labels map<string,string>, duration_us long, enrichment_state string, "
    "network_data struct<src_ip:string,src_port:int,dst_ip:string,dst_port:int,protocol:string,direction:string,bytes_sent:long,bytes_received:long>, "
    "process_data struct<pid:long,ppid:long,command:string,executable:string,uid:long,exit_code:int>"
)

TCP = ("kernel.tcp.connect", "kernel.tcp.close", "kernel.tcp.retransmit")
TYPES = (*TCP, "kernel.process.exec", "kernel.file.open", "kernel.file.open_attempt")
#: Types that agents emit about themselves; they are never dropped as unbound.
AGENT_TYPES = ("agent.gap", "agent.probe.parse_errors", "agent.probe.status")
