"""Small fixed dimensions: themes of root codes, countries, search centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The 20 root codes and the six themes that group them.
ROOT_CODES = [f"{n:02d}" for n in range(1, 21)]

THEMES = {
    "diplomacy": ("Diplomacy & Statements", ["01", "02", "03", "04", "05"]),
    "cooperation": ("Cooperation & Aid", ["06", "07", "08"]),
    "disputes": ("Disputes & Demands", ["09", "10", "11", "12"]),
    "protest": ("Protest & Dissent", ["14"]),
    "coercion": ("Coercion & Threats", ["13", "15", "16", "17"]),
    "conflict": ("Conflict & Violence", ["18", "19", "20"]),
}

# FIPS 10-4 country code and common name, one pair per line.
_COUNTRY_TEXT = """
US United States
IN India
UK United Kingdom
NI Nigeria
AS Australia
CH China
CA Canada
IS Israel
PK Pakistan
RP Philippines
SF South Africa
FR France
JA Japan
IR Iran
EI Ireland
NZ New Zealand
RS Russia
GM Germany
MY Malaysia
CE Sri Lanka
GR Greece
KE Kenya
IT Italy
CU Cuba
KS South Korea
BG Bangladesh
UP Ukraine
ID Indonesia
TU Turkey
SP Spain
EG Egypt
GH Ghana
SN Singapore
MX Mexico
VM Vietnam
TH Thailand
VE Venezuela
SZ Switzerland
SA Saudi Arabia
UG Uganda
ZI Zimbabwe
TW Taiwan
NP Nepal
NL Netherlands
AE United Arab Emirates
SY Syria
FJ Fiji
BE Belgium
MU Oman
QA Qatar
LE Lebanon
BR Brazil
AF Afghanistan
IZ Iraq
BA Bahrain
AL Albania
HA Haiti
MI Malawi
AU Austria
CI Chile
JM Jamaica
SO Somalia
NO Norway
SU Sudan
PO Portugal
AM Armenia
EZ Czech Republic
PL Poland
SW Sweden
RO Romania
YM Yemen
GY Guyana
DA Denmark
HK Hong Kong
AJ Azerbaijan
TZ Tanzania
PE Peru
JO Jordan
CY Cyprus
BB Barbados
WA Namibia
CO Colombia
KU Kuwait
CG Democratic Republic Of The Congo
ML Mali
MO Morocco
TD Trinidad And Tobago
BU Bulgaria
BN Benin
MT Malta
RW Rwanda
GG Georgia
CB Cambodia
PM Panama
PP Papua New Guinea
GA Gambia
AR Argentina
SL Sierra Leone
ZA Zambia
MK Macedonia
NG Niger
BF Bahamas
KZ Kazakhstan
BM Myanmar
AG Algeria
LU Luxembourg
OD South Sudan
SG Senegal
MC Macau
CD Chad
MA Madagascar
LH Lithuania
IC Iceland
ET Ethiopia
DR Dominican Republic
WS Samoa
BH Belize
KN North Korea
FI Finland
HU Hungary
BX Brunei
MN Monaco
NS Suriname
GV Guinea
VT Vatican City
TS Tunisia
KV Kosovo
CM Cameroon
CF Congo
LY Libya
EN Estonia
ST Saint Lucia
GL Greenland
BO Belarus
AO Angola
ES El Salvador
BT Bhutan
BC Botswana
UV Burkina Faso
MZ Mozambique
LI Liberia
CT Central African Republic
SE Seychelles
EC Ecuador
ER Eritrea
MV Maldives
UZ Uzbekistan
VC Saint Vincent And The Grenadines
LA Laos
RM Marshall Islands
IV Cote D'ivoire
NU Nicaragua
MP Mauritius
CS Costa Rica
UY Uruguay
TN Tonga
KR Kiribati
TI Tajikistan
GT Guatemala
BL Bolivia
DJ Djibouti
RB Serbia
RI Serbia
LO Slovak Republic
GJ Grenada
LT Lesotho
BP Solomon Islands
KG Kyrgyzstan
MD Moldova
HO Honduras
MG Mongolia
TO Togo
BK Bosnia-Herzegovina
AC Antigua And Barbuda
TX Turkmenistan
TV Tuvalu
PA Paraguay
LG Latvia
MJ Montenegro
AN Andorra
HR Croatia
"""

# Centroids a place search can fly to (name, latitude, longitude).
_CENTROID_TEXT = """
Afghanistan, 33.9, 67.7
Algeria, 28.0, 1.7
Argentina, -38.4, -63.6
Australia, -25.3, 133.8
Austria, 47.5, 14.6
Bangladesh, 23.7, 90.4
Belgium, 50.5, 4.5
Bolivia, -16.3, -63.6
Brazil, -14.2, -51.9
Canada, 56.1, -106.3
Chile, -35.7, -71.5
China, 35.9, 104.2
Colombia, 4.6, -74.3
Cuba, 21.5, -77.8
Czechia, 49.8, 15.5
DR Congo, -4.0, 21.8
Denmark, 56.3, 9.5
Ecuador, -1.8, -78.2
Egypt, 26.8, 30.8
Ethiopia, 9.1, 40.5
Finland, 61.9, 25.7
France, 46.2, 2.2
Germany, 51.2, 10.5
Ghana, 7.9, -1.0
Greece, 39.1, 21.8
Hungary, 47.2, 19.5
Iceland, 64.9, -19.0
India, 20.6, 79.0
Indonesia, -0.8, 113.9
Iran, 32.4, 53.7
Iraq, 33.2, 43.7
Ireland, 53.4, -8.2
Israel, 31.0, 34.9
Italy, 41.9, 12.6
Japan, 36.2, 138.3
Jordan, 30.6, 36.2
Kazakhstan, 48.0, 66.9
Kenya, -0.02, 37.9
Lebanon, 33.9, 35.9
Libya, 26.3, 17.2
Malaysia, 4.2, 102.0
Mexico, 23.6, -102.6
Morocco, 31.8, -7.1
Myanmar, 21.9, 95.9
Nepal, 28.4, 84.1
Netherlands, 52.1, 5.3
New Zealand, -40.9, 174.9
Nigeria, 9.1, 8.7
North Korea, 40.3, 127.5
Norway, 60.5, 8.5
Pakistan, 30.4, 69.3
Peru, -9.2, -75.0
Philippines, 12.9, 121.8
Poland, 51.9, 19.1
Portugal, 39.4, -8.2
Qatar, 25.4, 51.2
Romania, 45.9, 25.0
Russia, 61.5, 105.3
Saudi Arabia, 23.9, 45.1
Singapore, 1.35, 103.8
Somalia, 5.2, 46.2
South Africa, -30.6, 22.9
South Korea, 35.9, 127.8
Spain, 40.5, -3.7
Sri Lanka, 7.9, 80.8
Sudan, 12.9, 30.2
Sweden, 60.1, 18.6
Switzerland, 46.8, 8.2
Syria, 34.8, 39.0
Taiwan, 23.7, 121.0
Tanzania, -6.4, 34.9
Thailand, 15.9, 101.0
Turkey, 38.96, 35.2
Ukraine, 48.4, 31.2
United Arab Emirates, 23.4, 53.8
United Kingdom, 55.4, -3.4
United States, 37.1, -95.7
Uruguay, -32.5, -55.8
Venezuela, 6.4, -66.6
Vietnam, 14.1, 108.3
Yemen, 15.6, 48.5
Zimbabwe, -19.0, 29.2
"""

# Regions with their viewing altitude (name, latitude, longitude, altitude).
_REGION_TEXT = """
Africa, 1.5, 17.8, 2.2
East Asia, 32.0, 114.0, 2.0
Europe, 50.5, 12.0, 1.8
Latin America, -12.0, -66.0, 2.2
Middle East, 29.0, 45.0, 1.8
North America, 45.0, -100.0, 2.2
Oceania, -25.0, 145.0, 2.2
South Asia, 22.0, 79.0, 2.0
Southeast Asia, 8.0, 110.0, 2.0
"""

COUNTRIES: list[tuple[str, str]] = [
    (line[:2], line[3:]) for line in _COUNTRY_TEXT.strip().splitlines()
]


def _place(line: str, kind: str) -> tuple[str, str, float, float, float]:
    name, lat, lon, *altitude = line.split(", ")
    return kind, name, float(lat), float(lon), float(altitude[0]) if altitude else 1.4


# (kind, name, lat, lon, altitude), regions before countries as in search results.
PLACES = [_place(line, "region") for line in _REGION_TEXT.strip().splitlines()] + [
    _place(line, "country") for line in _CENTROID_TEXT.strip().splitlines()
]


def codes_for_themes(themes: list[str]) -> list[str]:
    """Sorted distinct union of the themes' root codes; an unknown theme is a KeyError."""
    return sorted({code for theme in themes for code in THEMES[theme][1]})


def places_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PLACES, "kind string, name string, lat double, lon double, altitude double"
    )
