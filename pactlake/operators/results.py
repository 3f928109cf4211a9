"""Outcomes of an evaluation: the error catalogue, the outcome tree, and its projections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: Error codes and their English templates.
MESSAGES = {
    "additional_property_mismatch": "Additional property {property} does not match the schema",
    "additional_properties_mismatch": "Additional properties {properties} do not match the schema",
    "additional_property_false": "Additional property '{property}' not allowed",
    "all_of_item_mismatch": "Value does not match the allOf schema at index {indexs}",
    "any_of_item_mismatch": "Value does not match anyOf schema",
    "if_then_mismatch": "Value meets the 'if' condition but does not match the 'then' schema",
    "if_else_mismatch": "Value fails the 'if' condition and does not match the 'else' schema",
    "const_mismatch_null": "Value should be null",
    "const_mismatch": "Value does not match the constant value",
    "contains_too_few_items": "Value should contain at least {min_contains} matching items",
    "contains_too_many_items": "Value should contain no more than {max_contains} matching items",
    "unsupported_encoding": "Encoding '{encoding}' is not supported",
    "invalid_encoding": "Error decoding data with '{encoding}'",
    "unsupported_media_type": "Media type '{media_type}' is not supported",
    "invalid_media_type": "Error unmarshalling data with media type '{media_type}'",
    "content_schema_mismatch": "Content does not match the schema",
    "dependent_property_required": "Some required property dependencies are missing: {missing_properties}",
    "dependent_required_missing": "Property {property} is required when {dependent_property} is present",
    "dependent_schema_mismatch": "Property {property} does not match the dependent schema",
    "dependent_schemas_mismatch": "Properties {properties} do not match the dependent schemas",
    "value_not_in_enum": "Value {received} should be one of the allowed values: {expected}",
    "exclusive_maximum_mismatch": "{value} should be less than {exclusive_maximum}",
    "exclusive_minimum_mismatch": "{value} should be greater than {exclusive_minimum}",
    "format_mismatch": "Value does not match format '{format}'",
    "unknown_format": "Unknown format '{format}'",
    "item_mismatch": "Item at index {index} does not match the schema",
    "items_mismatch": "Items at index {indexs} do not match the schema",
    "items_too_long": "Value should have at most {max_items} items",
    "string_too_long": "Value should be at most {max_length} characters",
    "too_many_properties": "Value should have at most {max_properties} properties",
    "value_above_maximum": "{value} should be at most {maximum}",
    "items_too_short": "Value should have at least {min_items} items",
    "string_too_short": "Value should be at least {min_length} characters",
    "too_few_properties": "Value should have at least {min_properties} properties",
    "value_below_minimum": "{value} should be at least {minimum}",
    "invalid_multiple_of": "Multiple of {divisor} should be greater than 0",
    "not_multiple_of": "{value} should be a multiple of {divisor}",
    "not_schema_mismatch": "Value should not match the not schema",
    "one_of_multiple_matches": "Value should match exactly one schema but matches multiple at indexes {matches}",
    "one_of_item_mismatch": "Value does not match the oneOf schema",
    "invalid_pattern": "Invalid regular expression pattern {pattern}",
    "pattern_mismatch": "Value does not match the required pattern {pattern}",
    "pattern_property_mismatch": "Property {property} does not match the pattern schema",
    "pattern_properties_mismatch": "Properties {properties} do not match their pattern schemas",
    "prefix_item_mismatch": "Item at index {index} does not match the prefixItems schema",
    "prefix_items_mismatch": "Items at index {indexs} do not match the prefixItems schemas",
    "property_mismatch": "Property {property} does not match the schema",
    "properties_mismatch": "Properties {properties} do not match their schemas",
    "property_name_mismatch": "Property name {property} does not match the schema",
    "property_names_mismatch": "Property names {properties} do not match the schema",
    "missing_required_property": "Required property {property} is missing",
    "missing_required_properties": "Required properties {properties} are missing",
    "required_missing": "Required property {property} is missing",
    "type_mismatch": "Value is {received} but should be {expected}",
    "unevaluated_items_not_allowed": "Unevaluated items are not allowed at indexes: {indexes}",
    "unevaluated_item_mismatch": "Item at index {index} does not match the unevaluatedItems schema",
    "unevaluated_items_mismatch": "Items at indexes {indexes} do not match the unevaluatedItems schema",
    "unevaluated_property_mismatch": "Property {property} does not match the unevaluatedProperties schema",
    "unevaluated_properties_mismatch": "Properties {properties} do not match the unevaluatedProperties schema",
    "unique_items_mismatch": "Array items at indices {index1} and {index2} are not unique",
    "invalid_json": "Invalid JSON format",
    "ref_mismatch": "Value does not match the reference schema",
    "dynamic_ref_mismatch": "Value does not match the dynamic reference schema",
    "false_schema_mismatch": "No values are allowed because the schema is set to 'false'",
    "invalid_numeric": "Value is {received} but should be numeric",
}
#: A translator of (code, parameters); None falls back to English.
Translator = Callable[[str, dict[str, str]], "str | None"]


@dataclass
class Error:
    keyword: str
    code: str
    params: dict[str, str] = field(default_factory=dict)

    def message(self, translate: Translator | None = None) -> str:
        text = (translate and translate(self.code, self.params)) or MESSAGES[self.code]
        for name, value in self.params.items():
            text = text.replace("{" + name + "}", value)
        return text


@dataclass
class Outcome:
    """What one node says of one value, and of the parts below."""

    evaluation_path: str = ""
    schema_location: str = ""
    instance_location: str = ""
    errors: list[Error] = field(default_factory=list)
    details: list[Outcome] = field(default_factory=list)
    annotations: dict[str, Any] = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return not self.errors

    def by_keyword(self) -> dict[str, Error]:
        """One error for each keyword; of several, the last."""
        return {e.keyword: e for e in self.errors}

    def flag(self) -> dict[str, bool]:
        return {"valid": self.valid}

    def _own(self, translate: Translator | None) -> dict[str, Any]:
        out: dict[str, Any] = {"valid": self.valid, "evaluationPath": self.evaluation_path, "schemaLocation": self.schema_location, "instanceLocation": self.instance_location}
        if self.errors:
            out["errors"] = {k: e.message(translate) for k, e in self.by_keyword().items()}
        if self.annotations and self.valid:
            out["annotations"] = self.annotations
        return out

    def to_list(self, hierarchy: bool = True, translate: Translator | None = None) -> dict[str, Any]:
        """The tree, nested or with all its nodes in one depth-first list."""
        own = self._own(translate)
        if hierarchy:
            return own | ({"details": [d.to_list(True, translate) for d in self.details]} if self.details else {})
        return own | {"details": [d._own(translate) for d in self.below()]}

    def below(self):
        for d in self.details:
            yield d
            yield from d.below()

    def flat(self) -> list[tuple[str, Error]]:
        """(instance location, error) of every node, depth first."""
        return [(o.instance_location, e) for o in (self, *self.below()) for e in o.by_keyword().values()]

    def detailed_errors(self, translate: Translator | None = None) -> dict[str, str]:
        """Messages by location and keyword."""
        return {f"{at}/{e.keyword}": e.message(translate) for at, e in self.flat()}
