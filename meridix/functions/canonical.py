"""Canonical JSON, its fingerprints and the ids that follow from them, all inside the JVM.

VARIANT keeps an object's fields in the order of their names at every level, and its text is compact: reading JSON into it
and writing it out is the recursive sort. Numbers come out as the engine spells them: 1.0 and 1 are one number, as are 1.10
and 1.1. A text that is no JSON, or that repeats a name in an object, has no canonical form (null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    return F.to_json(F.try_parse_json(text))


def stable_json(**fields: Column) -> Column:
    """Canonical JSON of an object from columns of any type (nested ones too); nulls stay as nulls."""
    return F.to_json(F.to_variant_object(F.struct(*[c.alias(name) for name, c in fields.items()])))


def fingerprint(json: Column) -> Column:
    return F.sha2(json, 256)


def derived(prefix: str, **fields: Column) -> Column:
    """An id from the object's fingerprint."""
    return F.concat(F.lit(prefix + "_"), F.substring(fingerprint(stable_json(**fields)), 1, 40))


def source_record_id(source: Column, key: Column, raw_fingerprint: Column) -> Column:
    """One observation: the record's key and what it said."""
    return derived("sr", source_name=F.lower(F.trim(source)), source_record_key=key, raw_fingerprint=raw_fingerprint)


def lead_id(source: Column, key: Column, record_id: Column) -> Column:
    """The record's own key if there is one, whatever it says; else the observation."""
    name = F.lower(F.trim(source))
    return F.when(key.isNotNull(), derived("lead", source_name=name, source_record_key=key)).otherwise(derived("lead", source_name=name, source_record_key=key, source_record_id=record_id))


def observation_id(lead: Column, source_field: Column, field: Column, value: Column) -> Column:
    return derived("obs", lead_id=lead, source_field_name=source_field, canonical_field=field, normalized_value=value)


def finding_id(record_id: Column, lead: Column, rule: Column, field: Column, code: Column, observed: Column, version: Column) -> Column:
    return derived("finding", source_record_id=record_id, lead_id=lead, rule_id=rule, field=field, code=code, observed_value_ref=observed, validation_version=version)


def duplicate_decision_id(record_id: Column, rule: Column) -> Column:
    return derived("dup", source_record_id=record_id, rule_id=rule)


def source_fingerprint(source: Column, version: Column, key: Column, adapter: Column, mapped: Column) -> Column:
    """Of a mapped record: ``mapped`` is an array of structs canonical_field, source_field_name, raw_value."""
    return fingerprint(stable_json(source_name=source, source_version=version, source_record_key=key, adapter_version=adapter, mapped_fields=mapped))
