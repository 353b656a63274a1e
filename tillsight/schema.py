"""Canonical columns of the engine's tables. Money is decimal(19,4); times are UTC timestamps."""

from __future__ import annotations

MONEY = "decimal(19,4)"

DOCUMENTS = f"""document_id string, type string, device_id string, session_id string, job_id string, order_code string,
table_code string, operator_code string, terminal_code string, external_code string, external_suffix string,
suffix_evidence string, commercial_reference string, document_time timestamp, captured_at timestamp, gross_total {MONEY},
net_total {MONEY}, discount_total {MONEY}, complete boolean, economic_close boolean, settlement_kind string,
order_reference string, payload_sha256 string"""
LINES = f"""document_id string, sequence int, item_code string, description string, quantity {MONEY}, unit_price {MONEY},
modified_unit_price {MONEY}, discount {MONEY}, line_total {MONEY}, removed boolean"""
PAYMENTS = f"document_id string, method string, amount {MONEY}"

#: The document and event vocabulary.
SOURCE_TYPES = ("ORDER", "ORDER_CHANGE", "KITCHEN_ORDER", "PRE_BILL", "MANAGEMENT_DOCUMENT")
OPENING_TYPES = ("ORDER", "PRE_BILL")
FISCAL_TYPES = ("COMMERCIAL_DOCUMENT",)
FOLLOWUP_TYPES = ("COMMERCIAL_DOCUMENT", "REFUND", "PAYMENT", "CANCELLATION")
SIBLING_TYPES = ("COMMERCIAL_DOCUMENT", "REFUND", "PAYMENT")
AUXILIARY_TYPES = ("CONFORMING_COPY", "REPRINT", "DEVICE_RESPONSE", "REFUND", "SHIFT_END_REPORT", "INVOICE")
COPY_TYPES = ("CONFORMING_COPY", "REPRINT")
NON_SALE_TYPES = ("SHIFT_END_REPORT", "INVOICE")
OPERATIONAL_STATES = ("OPEN", "UNDER_REVIEW", "CONFIRMED")
ARCHIVE_STATES = ("FALSE_POSITIVE", "JUSTIFIED", "CLOSED")


def names(ddl: str) -> list[str]:
    """Column names of a DDL string."""
    import re

    return re.findall(r"(?:^|,)\s*(\w+) (?:string|int|boolean|timestamp|decimal)", ddl)
