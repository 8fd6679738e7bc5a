"""Time zones by the names that Windows gives them."""

from __future__ import annotations

import zoneinfo

# Windows zone names and their zones, of the public CLDR table.
WINDOWS_ZONES = """
AUS Central Standard Time = Australia/Darwin
AUS Eastern Standard Time = Australia/Sydney
Afghanistan Standard Time = Asia/Kabul
Alaskan Standard Time = America/Anchorage
Arab Standard Time = Asia/Riyadh
Arabian Standard Time = Asia/Dubai
Arabic Standard Time = Asia/Baghdad
Atlantic Standard Time = America/Halifax
Canada Central Standard Time = America/Regina
Central America Standard Time = America/Guatemala
Central Asia Standard Time = Asia/Almaty
Central Europe Standard Time = Europe/Budapest
Central European Standard Time = Europe/Warsaw
Central Pacific Standard Time = Pacific/Guadalcanal
Central Standard Time = America/Chicago
Central Standard Time (Mexico) = America/Mexico_City
China Standard Time = Asia/Shanghai
E. Africa Standard Time = Africa/Nairobi
E. Australia Standard Time = Australia/Brisbane
E. Europe Standard Time = Europe/Chisinau
E. South America Standard Time = America/Sao_Paulo
Eastern Standard Time = America/New_York
Egypt Standard Time = Africa/Cairo
FLE Standard Time = Europe/Kiev
GMT Standard Time = Europe/London
GTB Standard Time = Europe/Bucharest
Georgian Standard Time = Asia/Tbilisi
Greenwich Standard Time = Atlantic/Reykjavik
Hawaiian Standard Time = Pacific/Honolulu
India Standard Time = Asia/Kolkata
Iran Standard Time = Asia/Tehran
Israel Standard Time = Asia/Jerusalem
Japan Standard Time = Asia/Tokyo
Korea Standard Time = Asia/Seoul
Mountain Standard Time = America/Denver
Mountain Standard Time (Mexico) = America/Chihuahua
Myanmar Standard Time = Asia/Rangoon
N. Central Asia Standard Time = Asia/Novosibirsk
Nepal Standard Time = Asia/Kathmandu
New Zealand Standard Time = Pacific/Auckland
Newfoundland Standard Time = America/St_Johns
North Asia East Standard Time = Asia/Irkutsk
North Asia Standard Time = Asia/Krasnoyarsk
Pacific SA Standard Time = America/Santiago
Pacific Standard Time = America/Los_Angeles
Pacific Standard Time (Mexico) = America/Tijuana
Romance Standard Time = Europe/Paris
Russian Standard Time = Europe/Moscow
SA Eastern Standard Time = America/Cayenne
SA Pacific Standard Time = America/Bogota
SA Western Standard Time = America/La_Paz
SE Asia Standard Time = Asia/Bangkok
Singapore Standard Time = Asia/Singapore
South Africa Standard Time = Africa/Johannesburg
Sri Lanka Standard Time = Asia/Colombo
Taipei Standard Time = Asia/Taipei
Tasmania Standard Time = Australia/Hobart
Tokyo Standard Time = Asia/Tokyo
Turkey Standard Time = Europe/Istanbul
US Eastern Standard Time = America/Indianapolis
US Mountain Standard Time = America/Phoenix
UTC = UTC
UTC+12 = Pacific/Fiji
UTC-02 = America/Noronha
UTC-11 = Pacific/Pago_Pago
W. Australia Standard Time = Australia/Perth
W. Central Africa Standard Time = Africa/Lagos
W. Europe Standard Time = Europe/Berlin
West Asia Standard Time = Asia/Tashkent
West Pacific Standard Time = Pacific/Port_Moresby
Yakutsk Standard Time = Asia/Yakutsk
"""

_BY_NAME = {windows.lower(): zone for windows, zone in (x.split(" = ") for x in WINDOWS_ZONES.strip().splitlines())}


def resolve_zone(name: str | None) -> str | None:
    """The zone of a Windows name in any case, or a zone's own name as it is; null where neither is known. The result goes
    into the `zone` of the parsers, so that the shift itself runs in the engine."""
    if not name:
        return None
    return name if name in zoneinfo.available_timezones() else _BY_NAME.get(name.lower())
