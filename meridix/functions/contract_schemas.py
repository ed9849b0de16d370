"""Machine contracts, as JSON Schema. Objects are closed; times are plain texts, as no format checker looks at them."""

_ID, _TEXT, _SOME, _TIME = {"type": "string", "format": "uuid"}, {"type": "string"}, {"type": "string", "minLength": 1}, {"type": "string", "format": "date-time"}
_MAYBE = {"type": ["string", "null"]}

TRACKING_EVENT = {
    "type": "object", "additionalProperties": False,
    "required": ["event_id", "schema_version", "event_type", "occurred_at", "source_system", "environment", "correlation_id", "confidence", "payload"],
    "properties": {
        "event_id": _ID, "schema_version": _TEXT, "event_type": _SOME, "occurred_at": _TIME, "source_system": _SOME,
        "environment": {"type": "string", "enum": ["development", "staging", "production"]},
        "account_id": _MAYBE, "person_id": _MAYBE, "campaign_id": _MAYBE, "send_id": _MAYBE, "correlation_id": _SOME, "causation_id": _MAYBE,
        "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "payload": {"type": "object"},
    },
}

RENDERED_TREATMENT = {
    "type": "object", "additionalProperties": False,
    "required": ["schema_version", "enrollment_id", "campaign_id", "person_id", "account_id", "sequence_step_id", "strategy_version_id", "offer_version_id", "message_version_id", "cta_version_id", "sequence_version_id", "recipient_email", "subject", "body_text", "headers", "rendered_at"],
    "properties": {
        "schema_version": _TEXT, "enrollment_id": _ID, "campaign_id": _ID, "person_id": _TEXT, "account_id": _TEXT, "sequence_step_id": _ID,
        "strategy_version_id": _ID, "offer_version_id": _ID, "message_version_id": _ID, "cta_version_id": _ID, "sequence_version_id": _ID,
        "experiment_id": _MAYBE, "experiment_variant_id": _MAYBE, "recipient_email": {"type": "string", "format": "email"}, "subject": _SOME, "body_text": _SOME,
        "headers": {"type": "object", "additionalProperties": {"type": "string"}}, "asset": {"type": ["object", "null"]}, "personalization": {"type": ["object", "null"]},
        "reply_to": {"type": ["string", "null"], "format": "email"}, "rendered_at": _TIME,
    },
}

#: The treatment is any object here, as the contract has it; STRICT_SEND_REQUEST checks it too.
SEND_REQUEST = {
    "type": "object", "additionalProperties": False,
    "required": ["schema_version", "send_id", "idempotency_key", "campaign_id", "person_id", "sequence_step_id", "mailbox_id", "scheduled_at", "treatment"],
    "properties": {
        "schema_version": _TEXT, "send_id": _ID, "idempotency_key": _SOME, "campaign_id": _ID, "person_id": _TEXT, "sequence_step_id": _ID, "mailbox_id": _ID,
        "scheduled_at": _TIME, "treatment": {"type": "object"},
    },
}
STRICT_SEND_REQUEST = SEND_REQUEST | {"properties": SEND_REQUEST["properties"] | {"treatment": {"$ref": "#/$defs/treatment"}}, "$defs": {"treatment": RENDERED_TREATMENT}}

DUPLICATE_DECISION = {
    "type": "object", "additionalProperties": False,
    "required": ["decision_id", "source_record_id", "duplicate_type", "rule_id", "matched_source_record_ids", "comparison_keys", "decided_at", "decision_version"],
    "properties": {
        "decision_id": {"type": "string", "minLength": 3}, "source_record_id": {"type": "string", "minLength": 3},
        "duplicate_type": {"enum": ["replay", "exact_duplicate", "not_duplicate"]}, "rule_id": _SOME,
        "matched_source_record_ids": {"type": "array", "items": {"type": "string", "minLength": 3}}, "comparison_keys": {"type": "object"},
        "decided_at": _TIME, "decision_version": _SOME,
    },
}
