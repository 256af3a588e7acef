"""Word lists, patterns and lookup tables whose values are part of the results."""

# Common words, first list (spans found by patterns are checked against it).
COMMON = """
the a an
and but or nor for yet so
in on at to from with by of about
he she it they we you i
him her them us me
his its their our your my
is was are were be been being
have has had do does did
this that these those
when where what which who why how
patient treatment therapy care health
medical clinical hospital clinic doctor
mother father sister brother son daughter
wife husband partner friend family whanau
""".split()

# What the second list of common words has besides (second-pass scans are checked against both).
COMMON_MORE = """
january february march april may june july august
september october november december
monday tuesday wednesday thursday friday saturday sunday
new now old see way get let put say too use
very well more some than then only come could
""".split()

# Clinical terms.
CLINICAL = """
gp mdt aod a&d acc dhb ed icu ot pt
cbt dbt act emdr mi mh mha moh doh
camhs catt cat crisis eap eps ect
adhd add asd ocd ptsd gad mdd bpd npd
bai bdi phq gad7 k10 dass wais wisc
dsm icd dx rx tx hx sx prn qid tds bd
tbi cva ms cp ld id abi
ngo moe msd winz cyf senco
aa na ca ga saa slaa
aods cads dapaanz
fte pte ceo gm hr
nz usa uk au nsw vic qld
td tt tbc tba asap fyi nb ps re
methadone suboxone ritalin dexamphetamine
antidepressant antipsychotic anxiolytic benzodiazepine
turps cannabis methamphetamine amphetamine
specialist registrar consultant clinician
timeline formulation assessment intervention
current background history plan goals progress
summary recommendations actions notes comments
rehab reports
client supplier provider participant claimant
referrer coordinator author reviewer approver
name address phone email contact details
number date claim reference ref report file
""".split()

# Abbreviations with digits that are no identifiers (ordinals follow a rule).
ABBREVIATIONS = "covid19 covid-19 h1n1 mp3 mp4 a4 b12 c19 3d 4k 5g wifi id3".split() + [f"{n}{'th' if n in (11, 12, 13) else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}" for n in range(1, 32)]

# Known first and last names.
FIRST_NAMES = "Wiremu Hemi Pita Rawiri Mikaere Tane Rangi Tamati Hohepa Aperahama Timoti Hone Paora Aroha Kiri Mere Hana Anahera Moana Ngaire Whetu Kahu Ataahua Hinewai Hine Marama Ariana".split()
LAST_NAMES = ["Ngata", "Te Ao", "Tawhiri", "Wairua", "Takiri", "Parata", "Ngati", "Whaanga", "Eruera"]

# Relationship words that precede a name.
RELATIONSHIPS = """
mother father sister brother son daughter
grandmother grandfather grandma grandpa
aunt uncle cousin niece nephew
stepmother stepfather stepsister stepbrother
whanau whangai
wife husband partner spouse fiance fiancee
boyfriend girlfriend ex-wife ex-husband
friend flatmate roommate colleague coworker
neighbor neighbour mate buddy
""".split()

# Titles that precede a name, and titles that are taken off a name.
TITLES = "Mr Mrs Ms Miss Dr Prof Pastor Reverend Rev Father Fr Sir Dame Lord Lady Sister Nurse".split()

# Streets, suburbs, cities, hospitals, boards.
STREETS = "Road Street Terrace Avenue Drive Lane Place Crescent Way Grove Close Court".split()
SUBURBS = [
    "Otahuhu", "Manukau", "Papatoetoe", "Mangere", "Mt Eden", "Ponsonby", "Parnell", "Remuera", "Epsom", "Newmarket", "Grey Lynn", "Avondale",
    "New Lynn", "Henderson", "Albany", "Takapuna", "Devonport", "Ellerslie", "Panmure", "Howick", "Pakuranga", "Botany", "Flat Bush",
]
CITIES = ["Wellington", "Christchurch", "Dunedin", "Hamilton", "Tauranga", "Napier", "Hastings", "Palmerston North", "Rotorua", "Nelson", "Queenstown", "Invercargill", "Whangarei"]
HOSPITALS = ["Auckland", "Middlemore", "North Shore", "Waitakere", "Starship", "Greenlane", "Wellington", "Hutt", "Christchurch", "Dunedin"]
BOARDS = ["Auckland", "Waitemata", "Counties Manukau", "Canterbury", "Southern", "Capital & Coast", "Hutt Valley"]
MONTHS = "January February March April May June July August September October November December".split()
SHORT_MONTHS = [m[:3] for m in MONTHS]

# Two-letter prefixes that are abbreviations, particles within names, words that are names too.
CAPITAL_PREFIXES = "IT ID OK TV PC UK US EU AI HR PR QA".split()
PARTICLES = "von van de da del della di du la le los las bin ibn al el".split()
NAME_WORDS = """
sue will bill grant mark pat rob drew chase pierce wade earnest payton
april may june
hope joy faith grace rose belle dawn sky skye rain reign ash clay reed reid lane brook brooke blair sage
guy herb gene earl dean
""".split()

# Entity types with the prefixes of their codes, and name variants in their order.
PREFIXES = {
    "person_client": "CLIENT", "person_provider": "PROVIDER", "person_other": "PERSON", "date": "DATE", "location": "LOCATION",
    "organization": "ORG", "identifier": "ID", "contact": "CONTACT", "numeric_all": "NUM",
}
VARIANTS = "FULL FIRST_LAST FIRST LAST MIDDLE FORMAL FIRST_MID".split()
