"""SQL text shared by the checks: formulas written out for the second engine."""

from __future__ import annotations


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2*6371.0088*asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(({lat2})-({lat1}))/2),2)"
        f"+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians(({lon2})-({lon1}))/2),2))))))"
    )


def pmod(a: str, b: str) -> str:
    return f"((({a}) % {b} + {b}) % {b})"
