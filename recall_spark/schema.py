"""Table schemas. ``index_id`` is the tenant: the partition column and the first key of everything."""

from __future__ import annotations

SYNAPSES_DDL = "index_id string, synapse_id string, from_id string, to_id string, weight double, co_fire_count bigint, last_co_fire timestamp_ntz, created_at timestamp_ntz"
NEURONS_DDL = (
    "index_id string, neuron_id string, content string, content_hash string, position array<double>, energy double, "
    "base_energy double, depth int, created_at timestamp_ntz, last_fired_at timestamp_ntz, last_decay_at timestamp_ntz, "
    "access_count bigint, tags array<string>, sentiment_label string, sentiment_score double, embedding array<float>, "
    "metadata map<string,string>"
)
FIRES_DDL = "index_id string, neuron_id string, ts timestamp_ntz, seq bigint"
ACTIVITY_DDL = "index_id string, ts timestamp_ntz"
REGISTRY_DDL = "uuid string, metadata map<string,string>, created_at timestamp_ntz, updated_at timestamp_ntz"
