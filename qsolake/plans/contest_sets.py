"""What contest rules list: areas, entities, prefixes and band values."""

from __future__ import annotations

# Areas that stations send.
US_STATES = (
    "CT MA ME NH RI VT NY NJ DE PA MD DC AL GA KY NC FL SC TN VA AR LA MS NM TX OK CA HI AK AZ ID MT NV OR UT WA WY MI OH WV IL IN WI "
    "CO IA KS MN MO NE ND SD"
).split()
CANADIAN_PROVINCES = "NB NS QC ON MB SK AB BC NT NF LB YT PE NU".split()
CALIFORNIA_PARTY_PROVINCES = "MR QC ON MB SK AB BC NT".split()
NEW_YORK_PARTY_PROVINCES = "MAR NL QC ON MB SK AB BC NT".split()
NEW_YORK_COUNTIES = (
    "ALB ALL BRX BRM CAT CAY CHA CHE CGO CLI COL COR DEL DUT ERI ESS FRA FUL GEN GRE HAM HER JEF KIN LEW LIV MAD MON MTG NAS NEW NIA "
    "ONE ONO ONT ORA ORL OSW OTS PUT QUE REN ROC RIC SAR SCH SCO SCU SEN STL STE SUF SUL TIO TOM ULS WAR WAS WAY WES WYO YAT"
).split()
RAC_PROVINCES = "NS QC ON MB SK AB BC NT NB NL NU YT PE".split()
RAC_STATIONS = "VA2RAC VA3RAC VE1RAC VE4RAC VE5RAC VE6RAC VE7RAC VE8RAC VE9RAC VO1RAC VO2RAC VY0RAC VY1RAC VY2RAC".split()
ARRL_160_SECTIONS = (
    "AK AL AR AZ CO CT DE EB EMA ENY EPA EWA GA IA ID IL IN KS KY LA LAX MDC ME MI MN MO MS MT NC ND NE NFL NH NLI NM NNJ NNY NTX NV OH "
    "OK OR ORG PAC PR RI SB SC SCV SD SDG SF SFL SJV SNJ STX SV TN UT VA VI VT WI WCF WMA WNY WPA WTX WV WWA WY AB BC MAR MB NL NT ON QC SK"
).split()
ARRL_SECTIONS = (
    "CO IA KS MN MO ND NE SD CT EMA ME NH RI VT WMA ENY NLI NNJ NNY SNJ WNY DE EPA MDC WPA AL GA KY NC NFL PR SC SFL TN VA VI WCF AR LA "
    "MS NM NTX OK STX WTX EB LAX ORG PAC SB SCV SDG SF SJV SV AK AZ EWA ID MT NV OR UT WWA WY MI OH WV IL IN WI AB BC GH MB NB NL NS ONE "
    "ONN ONS PE QC SK TER"
).split()
ITALIAN_PROVINCES = (
    "AL AT BI CN GE IM NO SP SV TO VB VC AO BG BS CO CR LC LO MB MI MN PV SO VA BL PD RO TV VE VI VR BZ TN GO PN TS UD BO FC FE MO PC PR "
    "RA RE RN AR FI GR LI LU MS PI PO PT SI AN AP AQ CH FM MC PE PS PU TE BA BR BT FG LE MT TA AV BN CB CE CS CZ IS KR NA PZ RC SA VV FR "
    "LT PG RI RM ROMA TR VT AG CL CT EN ME PA RG SR TP CA CI NU OG OR OT SS VS"
).split()
SWISS_CANTONS = "AG AI AR BE BL BS FR GE GL GR JU LU NE NW OW SG SH SO SZ TG TI UR VD VS ZG ZH".split()
BULGARIAN_DISTRICTS = "BU BL DO GA HA KA KD LV MN PA PD PK PL RS RZ SF SL SM SN SO SS SZ TA VD VN VT VR YA".split()
DUTCH_PROVINCES = "GR FR DR OV GD UT FL NH ZH NB ZL LB".split()
POLISH_VOIVODESHIPS = "B C D F G J K L M O P R S U W Z".split()
UKRAINIAN_OBLASTS = "CH CN CR DN DO HA HE HM IF KI KO KR KV LU LV NI OD PO RI SL SU TE VI VO ZA ZH ZP".split()
BELGIAN_PROVINCES = "AN BW HT LB LG NM LU OV VB WV BR".split()
SPANISH_PROVINCES = (
    "A AB AL AV B BA BI BU C CA CC CE CO CR CS CU GC GI GR GU H HU IB J L LE LO LU M MA ML MU NA O OU P PO S SA SE SG SO SS T TE TF TO V "
    "VA VI Z ZA"
).split()
MEXICAN_STATES = (
    "AGS BC BCS CAM CHS CHH COA COL DF EMX DGO GTO GRO HGO JAL MIC MOR NAY NL OAX PUE QRO QTR SLP SIN SON TAB TMS TLX VER YUC ZAC"
).split()
ROMANIAN_COUNTIES = (
    "AR CS HD TM BU IF CT BR GL TL VN AB BH BN CJ SM SJ MM BV CV HR MS SB AG DJ GJ MH OT VL BC BT IS NT SV VS BZ CL DB GR IL PH TR"
).split()
RSGB_160_DISTRICTS = (
    "AB EL LE SK AL EC LL SL BM EH LN SM BA EN LS SN BB EX LU SO BD FK MR SP BH FY ME SR BL GS MK SS BN GL ML ST BR GU NL SW BS GY NE SY "
    "BT HA NG TA CA HD NN TD CB HG NP TF CF HP NR TN CH HR NW TQ CM HS OL TR CO HU OX TS CR HX PA TW CT IG PE UB CV IM PH WL CW IP PL WA "
    "DA IV PO WC DD JE PR WD DE KA RG WF DG KT RH WN DH KW RM WR DL KY SD WS DN LP SA WV DT LA SE YO DY LD SG ZE"
).split()
UKEI_DISTRICTS = (
    "AB AL AN AR BA BB BD BH BL BM BN BR BS CA CB CE CF CH CK CL CM CN CO CR CT CV CW DA DD DE DG DH DL DN DO DR DT DU DW DY EC EH EL EN "
    "EX FE FK FY GA GL GS GU GY HA HD HG HP HR HS HU HX IG IM IP IV JE KA KD KE KI KT KW KY LA LD LE LF LH LI LL LN LO LP LS LT LU MA ME "
    "MK ML MO MR MT NE NG NL NN NP NR NW OF OL OX PA PE PH PL PO PR RG RH RM RO SA SD SE SG SI SK SL SM SN SO SP SR SS ST SW SY TA TD TF "
    "TI TN TQ TR TS TW TY UB WA WC WD WF WI WL WM WN WR WS WT WV WX YO ZE"
).split()

# Entities, by their primary prefix.
UK = "G GD GI GJ GM GU GW".split()
RUSSIAN = "RA1 RA2 RA0 R1F R1M".split()
SCANDINAVIAN = "OH OH0 OX OY OZ SM LA JW JX TF".split()
PORTUGUESE = "CT CT3 CU".split()
BALTIC = "ES YL LY".split()
ITALIAN = "I IS IT9".split()
JAPANESE = "JA JD/O JD1/M".split()
CZECH_SLOVAK = "OK OM".split()
BY_AREA = "JA VE W VK".split()
PACC_AREAS = "RA0 UA9 CE JA LU PY VE W VK ZS ZL".split()
RNARS_AREAS = "VE VK W ZL ZS".split()
SCC_AREAS = "W VE VK ZL ZS JA PY RA0 LU".split()
WAE_AREAS = "W VE VK ZL ZS JA PY RA0".split()
AP_SPRINT = (
    "3D2 3D2R 3D2C 4W 1S 9M2 9M6 9V BV BV9 BY BS7 C2 DU FK FK8C FW H4 H40 HL HS JA JD/O JD1M KH2 KH9 KH0 P2 T2 T30 T33 T8 RA0 V6 V7 V8 VK "
    "VK9L VK9M VK9N VK9W VR XU 3W XX9 YB YJ ZL ZL9"
).split()
EUDXC = (
    "OE ON LZ OK OM 5B 9A OZ OX ES OH OH0 OY OJ0 F PJ7 FG FH FS FJ FY DL SV SV5 SV9 HA EI I IG9 IT9 IS0 LY YL LX 9H PA SP CT CT3 CU YO EA "
    "EA6 EA9 SM"
).split()
WAE_EUROPE = (
    "1A 3A 4O 4U1I 4U1V 9A 9H C3 CT CU DL E7 EA EA6 EI ER ES EU F G GD GI GJ GM GU GW HA HB HB0 HV I IS IT9 JW JX LA LX LY LZ OE OH OH0 OJ0 "
    "OK OM ON OY OZ PA R1F RA RA1 RA2 S5 SM SP SV SV5 SV9 T7 TA1 TF TK UR YL YO YU Z3 Z6 ZA ZB Z7 T9 R1M YU8"
).split()
FIELD_DAY_ZONES = [46, 47, 48, 52, 53, 57, 66, 67, 74, 75]
FIELD_DAY_ENTITIES = "FT8W FT8X FT8Z".split()

# Parts of call signs.
US_FRAGMENTS = "AA AB AC AD AE AF AI AJ AK AH KH NH WH AL KL NL WL KP NP WP AG KG NG WG K W N".split()
CANADIAN_FRAGMENTS = "CF CG CH CI CJ CK CY CZ VA VB VC VD VE VF VG VO VX VY XJ XK XL XM XN XO".split()
CIS_FRAGMENTS = "RI1AN 4J 4K EK ER EV EU EW EX EY EZ UK UJ UL UM UN UO UP UQ EM EN EO U R".split()
KCJ_PREFIXES = "7J 8J 7L 7N 7K 7M 8K 8L 8M 8N JA JB JC JD JE JF JG JH JI JJ JK JL JM JN JO JP JQ JR JS".split()
POLISH_PREFIXES = "HF SR SO SP 3Z SQ SN".split()
FRENCH_TERRITORY_PREFIXES = "TQ TP TM TW HX TH HW TV TO TK TX".split()
SARL_AREA_8 = "ZS7 ZS8 ZD9 7P 7Q C9 Z2 5R FR FH 9J A2 D2 V5".split()
JOLLY_CALLS = "IQ4FF I4JEE IZ4OSH IK4RDP IZ4ISC IZ4SJI".split()
ARR_CALLS = "CT1ARR CQ3EPC CS2EPC".split()

# Bands by the tokens of VHF logs, and values by band.
LEGACY_BANDS = {
    "50": "6M", "70": "4M", "144": "2M", "222": "1.25M", "432": "70CM", "903": "33CM", "1.2": "23CM", "2.3": "13CM", "3.4": "9CM",
    "5.6": "6CM", "10": "3CM", "24": "1.25CM", "47": "6MM", "76": "4MM", "119": "2.5MM", "142": "2MM", "241": "1MM",
}
WIA_FACTORS = {
    "10M": 1, "4M": 1, "2M": 3, "1.25M": 3, "70CM": 5, "33CM": 5, "23CM": 8, "13CM": 10, "9CM": 10, "6CM": 10, "3CM": 10,
    "1.25CM": 10, "6MM": 10, "4MM": 10, "2.5MM": 10, "2MM": 10, "1MM": 10,
}
SARL_VHF_FACTORS = {
    "10M": 2, "4M": 5, "2M": 2, "1.25M": 2, "70CM": 7, "33CM": 7, "23CM": 15, "13CM": 15, "9CM": 15, "6CM": 15, "3CM": 15, "1.25CM": 15,
    "6MM": 15, "4MM": 15, "2.5MM": 15, "2MM": 15, "1MM": 15,
}
ARRL_VHF_POINTS = {
    "6M": 1, "4M": 1, "2M": 1, "1.25M": 2, "70CM": 2, "33CM": 3, "23CM": 3, "13CM": 4, "9CM": 4, "6CM": 4, "3CM": 4, "1.25CM": 4, "6MM": 4,
    "4MM": 4, "2.5MM": 4, "2MM": 4, "1MM": 4,
}
ARRL_VHF_JANUARY_POINTS = {
    "6M": 1, "4M": 1, "2M": 1, "1.25M": 2, "70CM": 2, "33CM": 4, "23CM": 4, "13CM": 8, "9CM": 8, "6CM": 8, "3CM": 8, "1.25CM": 8, "6MM": 8,
    "4MM": 8, "2.5MM": 8, "2MM": 8, "1MM": 8,
}
ARRL_UHF_POINTS = {
    "1.25M": 3, "70CM": 3, "33CM": 6, "23CM": 6, "13CM": 12, "9CM": 12, "6CM": 12, "3CM": 12, "1.25CM": 12, "6MM": 12, "4MM": 12,
    "2.5MM": 12, "2MM": 12, "1MM": 12,
}
ARI_SEZ_POINTS = {"160M": 2, "80M": 2, "40M": 1, "20M": 3, "15M": 5, "10M": 5}
OCEANIA_POINTS = {"160M": 20, "80M": 10, "40M": 5, "20M": 1, "15M": 2, "10M": 3}
JIDX_POINTS = {"160M": 4, "80M": 2, "40M": 1, "20M": 1, "15M": 1, "10M": 2}
WAE_WEIGHTS = {"80M": 4, "40M": 3, "20M": 2, "15M": 2, "10M": 2}
