"""Network addresses of both versions as SQL expressions; what isn't an address is null."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def address_number(address: Column) -> Column:
    """The 32-bit number of a dotted address; null for anything else."""
    octets = F.split(address, "\\.")
    number = sum((F.element_at(octets, i + 1).cast("long") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(address.rlike(f"^{_IPV4}$"), number)


def _dotted_hex(address: Column) -> Column:
    return F.lower(F.lpad(F.hex(address_number(address)), 8, "0"))


def address_hex(address: Column) -> Column:
    """The address as 8 or 32 hexadecimal digits; groups that ``::`` leaves out are filled in, a dotted end is two groups."""
    tail = F.regexp_extract(address, rf":({_IPV4})$", 1)
    hexed = _dotted_hex(tail)
    plain = F.when(tail != "", F.concat(F.regexp_replace(address, rf"{_IPV4}$", ""), F.left(hexed, F.lit(4)), F.lit(":"), F.right(hexed, F.lit(4)))).otherwise(address)
    sides = F.split(plain, "::")
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left, right = groups(F.element_at(sides, 1)), groups(F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")))
    n = F.size(left) + F.size(right)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - n, F.lit(0))), right)
    digits = F.array_join(F.transform(filled, lambda g: F.lpad(F.lower(g), 4, "0")), "")
    # at most one "::", which stands for a group or more; no other empty group, no group of five digits
    shaped = plain.rlike("^[0-9A-Fa-f:]+$") & ~plain.rlike("[0-9A-Fa-f]{5}|:::|^:[^:]|[^:]:$|::.*::")
    whole = F.when(F.size(sides) == 2, n <= 7).otherwise(n == 8)
    return F.when(address.rlike(f"^{_IPV4}$"), _dotted_hex(address)).when(shaped & F.contains(address, F.lit(":")) & whole, digits)


def in_network(address: Column, network: str) -> Column:
    """Whether an address is in a network, given as ``address/bits``; false for one of the other version, null for what is none."""
    net = ipaddress.ip_network(network, strict=False)
    first, last = (f"{int(x):0{net.max_prefixlen // 4}x}" for x in (net.network_address, net.broadcast_address))
    digits = address_hex(address)
    return F.when(digits.isNotNull(), (F.length(digits) == net.max_prefixlen // 4) & digits.between(first, last))
