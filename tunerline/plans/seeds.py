"""Seed dimensions. Fixed values that resolution results depend on."""

from __future__ import annotations

#: call sign, network, city
STATIONS = [
    ("WABC", "ABC", "New York"), ("WCBS", "CBS", "New York"), ("WNBC", "NBC", "New York"), ("WNYW", "FOX", "New York"),
    ("KABC", "ABC", "Los Angeles"), ("KCBS", "CBS", "Los Angeles"), ("KNBC", "NBC", "Los Angeles"), ("KTTV", "FOX", "Los Angeles"),
    ("WLS", "ABC", "Chicago"), ("WBBM", "CBS", "Chicago"), ("WMAQ", "NBC", "Chicago"), ("WFLD", "FOX", "Chicago"),
]

#: canonical name -> the names it has gone by
ALIASES = {
    "FanDuel Sports Network Detroit": ["Fox Sports Detroit", "FSN Detroit", "Bally Sports Detroit", "FanDuel Sports Network Detroit", "FanDuel SN Detroit"],
    "FanDuel Sports Network Ohio": ["Fox Sports Ohio", "FSN Ohio", "Bally Sports Ohio", "FanDuel Sports Network Ohio", "FanDuel SN Ohio"],
    "FanDuel Sports Network Southeast": ["Fox Sports Southeast", "FSN Southeast", "Bally Sports Southeast", "FanDuel Sports Network Southeast", "FanDuel SN Southeast"],
    "FanDuel Sports Network West": ["Fox Sports West", "FSN West", "Bally Sports West", "FanDuel Sports Network West", "FanDuel SN West"],
    "FanDuel Sports Network Sun": ["Fox Sports Sun", "FSN Sun", "Bally Sports Sun", "FanDuel Sports Network Sun"],
    "FanDuel Sports Network Arizona": ["Fox Sports Arizona", "Bally Sports Arizona", "FanDuel Sports Network Arizona"],
    "ESPN": ["ESPN", "ESPN USA", "ESPN 1", "ESPN HD"],
    "ESPN2": ["ESPN2", "ESPN 2", "ESPN2 HD"],
    "ESPNU": ["ESPNU", "ESPN U"],
    "ESPNews": ["ESPNews", "ESPN News"],
    "ESPN Deportes": ["ESPN Deportes", "ESPN Deportes HD"],
    "NFL Network": ["NFL Network", "NFLN"],
    "NFL RedZone": ["NFL RedZone", "NFL Red Zone", "RedZone"],
    "NBA TV": ["NBA TV", "NBATV"],
    "MLB Network": ["MLB Network", "MLBN"],
    "NHL Network": ["NHL Network", "NHLN"],
    "Golf Channel": ["Golf Channel", "The Golf Channel"],
    "CBS Sports Network": ["CBS Sports Network", "CBSSN"],
}
