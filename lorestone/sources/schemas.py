"""Schemas and enumerations of the store. The names and members are part of the data's format."""

ENTITIES = "entity_id string, scope string, entity_type string, key string, display_name string, attrs map<string,string>, first_seen timestamp, last_seen timestamp, updated_at timestamp"
OBSERVATIONS = "obs_id string, scope string, ts timestamp, kind string, actor_type string, actor_id string, on_behalf_of string, case_id string, confidentiality string, content string, content_vec array<float>, entity_refs array<string>"
FACTS = "fact_id string, scope string, subject_id string, predicate string, object_value string, object_id string, status string, confidence float, source_obs string, written_by string, valid_from timestamp, valid_to timestamp, updated_at timestamp, visibility string"
EDGES = "edge_id string, scope string, src_id string, dst_id string, relation string, from_fact string, valid_from timestamp, valid_to timestamp, updated_at timestamp"
AUDIT = "ts timestamp, actor_type string, actor_id string, operation string, target_table string, target_id string, payload_summary string"
CURSOR = "name string, ts timestamp, last_id string"
COVERAGE = "obs_id string, extracted_at timestamp"
VERTICES = "ch_id string, scope string, key string, entity_type string, display_name string, first_seen timestamp, last_seen timestamp"
PROPOSALS = "array<struct<subject:string,predicate:string,object_value:string,confidence:double>>"

KINDS = ["alert", "triage_decision", "investigation_note", "hunt_finding", "agent_action", "human_statement"]
ACTORS = ["human", "agent"]
CONFIDENTIALITY = ["internal", "restricted"]
STATUSES = ["proposed", "active", "retracted"]
VISIBILITIES = ["org", "scope"]
ENTITY_TYPES = ["ioc_ip", "ioc_domain", "ioc_hash", "asset", "user", "actor", "campaign", "malware", "technique", "tool", "case", "document"]
#: An open end of validity, and the id that stands for none.
FOREVER = "2105-12-31 23:59:59"
NIL = "00000000-0000-0000-0000-000000000000"
