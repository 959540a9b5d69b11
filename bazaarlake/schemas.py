"""Schemas of the four input tables."""

from __future__ import annotations

TRANSACTIONS = (
    "transaction_id string, user_id string, product_id string, merchant_id string, amount double, "
    "timestamp string, location string, payment_method string, category string"
)
USERS = (
    "user_id string, age int, annual_income double, city string, customer_segment string, "
    "preferred_categories array<string>, registration_date string"
)
PRODUCTS = "product_id string, name string, category string, price double, merchant_id string, rating double, stock int"
MERCHANTS = "merchant_id string, name string, category string, region string, commission_rate double, establishment_date string"
