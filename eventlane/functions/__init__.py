"""Scalar functions: keys and items."""

from eventlane.functions.items import is_narrow, item_field, item_value, pack_item
from eventlane.functions.keys import key_bytes, key_hex, key_order, parse_key

__all__ = ["is_narrow", "item_field", "item_value", "key_bytes", "key_hex", "key_order", "pack_item", "parse_key"]
