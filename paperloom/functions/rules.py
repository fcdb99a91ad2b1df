"""Fixed patterns that sort sentences, pages and notices, and the column expressions that apply them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Requirement categories by the words of a sentence, in order of precedence.
CATEGORY_RULES = (
    ("LEGAL", r"(?i)[\"“][A-Za-z ]{2,40}[\"”] means\b|\btermination (at|for) (company|owner|the )?\s?convenience|\b(date|notice|effect|consequences?) of termination|\btermination under paragraph|\bterminated works?\b"),
    ("SUBMISSION", r"(?i)\b(bid|tender|proposal|offer)s?\b.{0,40}\b(submi(t|ssion)|envelope|opening|copies)\b|\bsealed envelope|\bbid opening\b|\btechnical (and|&) commercial (proposal|offer)s?\b"),
    ("HSE", r"(?i)\b(safety|health|environmental (protection|impact|management|requirements?)|hse|ppe|hazard(ous)?|accident|first aid|permit to work|waste disposal|danger)\b"),
    ("QA_QC", r"(?i)\b(quality (assurance|control|plan|management)|qa/?qc|iso 9001|inspection and test plan|itp)\b"),
    ("COMMERCIAL", r"(?i)\b(liquidated damages|payment|invoice|price|pricing|prices|priced|cost of|registration cost|currency|customs dut(y|ies)|saudi riyal|sar\b|retention|bond|guarantee|letter of credit|penalt(y|ies)|\btax(es)?\b|vat\b|local content|lc scorecard|in-kingdom|advance payment|bill of quantities)"),
    ("PERSONNEL", r"(?i)\b(contractor\W{0,3}s?\W{0,2} (expatriate )?personnel|removal of .{0,30}personnel|project manager|site engineer|key personnel|curriculum vitae|cvs?\b|staff qualifications?|resident engineer|saudi(zation| nationals))\b"),
    ("LEGAL", r"(?i)\b(terminat(e|ion) (of|for) (the |this )?(contract|agreement|work)|termination (for|at) (the )?(convenience|default)|terminate (this|the) (contract|agreement)|force majeure|indemn(ity|ify)|liabilit(y|ies)|dispute|arbitration|governing law|claims?\b|change order|variation|constitute a change|breach|assignment of|intellectual property|confidential(ity)?|warrant(y|ies)|insurance|power of attorney|joint venture|consortium|excusable delay|suspension of)\b"),
    ("SUBCONTRACTOR", r"(?i)\b(subcontract(ing|ed)? (of |the )?(works?|limit)|approv\w* (of |the )?subcontractors?|subcontractors? (approval|qualifications?|list)|subcontract more than|percentage .{0,30}subcontract)"),
    ("SCHEDULE", r"(?i)\b(completion (date|period|time)|delivery (period|time|date)|milestones?|time schedule|project schedule|programme of works|level-?\d schedule|within \d+ (days|weeks|months)|critical path|primavera|baseline schedule)\b"),
    ("TECHNICAL", r"(?i)\b(\d+(\.\d+)?\s?kv|kva|mva|gis|ais|switchgear|transformers?|substation|busbar|breaker|disconnector|relay|protection|scada|rtu|telecom|fiber|fibre|cable|conductor|earthing|grounding|insulator|bay|feeder|capacitor|reactor|battery|charger|ct|cts|vt|vts|pt|metering|voltage|current|reactive power|undervoltage|overvoltage|harmonic|frequency|panel|cubicle|foundation|steel|concrete|civil|drawing|layout|data schedule|technical data|tmss|sec standard|specification|iec|ieee|ansi|type test|factory test|commissioning|installation|hvac|lighting|fire alarm|trench|duct|road|fence|building|terminations?|splice|osp|overload|short circuit|withstand|surge|handling|delivery and storage|trend|kvrms|mva)s?\b"),
    ("LEGAL", r"(?i)\b(paragraph \d+(\.\d+)*|schedule\s*[\"“]?[a-e][\"”]?\s+of this contract|notices? between the parties|delete in its entirety|project portions?|suspension period)\b"),
)
# Categories in which a proven gap blocks, and those that need evidence.
HARD_GATES = ("LEGAL", "EXPERIENCE", "FINANCIAL", "EQUIPMENT", "PERSONNEL", "QA_QC")
QUALIFYING = (*HARD_GATES, "COMMERCIAL", "HSE", "SUBCONTRACTOR")
# Disciplines in order; on a tie the first wins.
DISCIPLINES = (
    ("HVAC", r"(?i)hvac|air.condition|ventilation|chiller"),
    ("Fire protection", r"(?i)fire (alarm|fighting|protection|suppression|detection)"),
    ("SCADA & telecom", r"(?i)scada|telecom|\brtu\b|fib(er|re)|communication|opgw"),
    ("Protection & control", r"(?i)protection|relay|control panel|interlock|\bscheme"),
    ("Cables", r"(?i)\bcables?\b|termination|cable joint|trench"),
    ("LV / DC & lighting", r"(?i)lighting|\blv\b|dc system|batter(y|ies)|charger|\bups\b"),
    ("Quality", r"(?i)quality|inspection and test|\bitp\b"),
    ("HSE", r"(?i)safety|health|environment"),
    ("Commercial", r"(?i)pric(e|ing)|payment|bond|guarantee|invoice|local content"),
    ("Legal / contract terms", r"(?i)terms and conditions|general conditions|liabilit|termination of|arbitration|indemn"),
    ("Primary electrical (GIS / transformers)", r"(?i)switchgear|\bgis\b|transformer|busbar|circuit breaker|disconnector|\d+\s?kv"),
    ("Civil & structural", r"(?i)civil|concrete|foundation|building|excavation|steel structure|fence|road|drainage|gatehouse"),
)
NON_TECHNICAL = ("Commercial", "Legal / contract terms", "HSE", "Quality", "General")
# Headings of document parts, numbered titles, lines of a table of contents, words of a note, and limits.
PART_HEAD = r"^\s*((?i:SECTION|PART|CHAPTER|SCHEDULE|APPENDIX|ANNEX(?:URE)?|EXHIBIT|ATTACHMENT)\b\s*[-–]?\s*(?:(?i:NO)\.?\s*)?[\"“‘]?(?:\d{1,3}(?:\.\d{1,2})?|[IVXL]{1,6}|[A-Z])[\"”’]?(?:[\s:.,–—-].{0,89})?)$"
PART_CODE = r"^\s*(?i:SECTION|PART|CHAPTER|SCHEDULE|APPENDIX|ANNEX(?:URE)?|EXHIBIT|ATTACHMENT)\b\s*[-–]?\s*(?:(?i:NO)\.?\s*)?[\"“‘]?(?:\d{1,3}(?:\.\d{1,2})?|[IVXL]{1,6}|[A-Z])[\"”’]?[–-][A-Z]\b"
NUMBERED = r"^\s*(\d{1,2})(?:\.0)?\.?\s+([A-Z][A-Z0-9 &/,()-]{5,70})\s*$"
CONTENTS = r"(\.{3,}|\t|\s{3,})\s*[A-Z]?-?\d{1,4}\s*$"
NOTE = r"(?i)\b(shall|must|will|should|is|are|be|refer|provided|see)\b"
HEAD_LINES, HEAD_CHARS, MOST_SECTIONS = 80, 120, 40
# What is asked of a bidder with the bid, definitions, and what belongs to the work itself.
ASK = r"(?i)\b(bidders?|tenderers?|proposals?|offers?|bids?)\b[^.=]{0,80}\b(shall|must|should|is\s+required\s+to|are\s+required\s+to|to\s+be)\b[^.=]{0,40}\b(submit|provide|include|attach|enclose|furnish|sign|stamp|fill|accompan|complete)\w*|\b(submit|provide|include|attach|enclose|furnish|sign|stamp|fill|accompan|complete)\w*\s+(?:\w+\s+){0,6}(with|in|as\s+(?:an\s+)?attachment\s+to)\s+(the|his|their|this|its)\s+(bid|proposal|offer)\b|\bduly\s+(filled|signed|stamped|completed)"
NOT_ITEM = r"(?i)[\"“][^\"”]{2,40}[\"”]\s+means\b|=|\bmay\s+submit\b|\bonly\s+firms\b"
EXECUTION = r"(?i)\b(during\s+(the\s+)?(construction|execution|project|installation)|as-?built|manuals?|before\s+(energi[sz]ation|commissioning|mechanical\s+completion|delivery|shipment)|for\s+(company\s+)?(review\s+and\s+)?approval|after\s+(award|contract\s+(award|signature))|within\s+\d+\s+(days|weeks)\s+(after|from|of)\s+(the\s+)?(award|effective|contract))"
# What makes a notice one of the electricity sector.
RELEVANT = r"(?i)substation|transformer|transmission line|transmission|switchgear|gis|kv|overhead line|underground cable|power cable|electric|electrical|electricity|power plant|power station|power supply|grid|interconnect|distribution network|metering|scada|solar|photovoltaic|pv|wind farm|battery energy|bess|محطة محولات|محول|كهرب|خطوط نقل|جهد"
# Ids of material specifications.
SPEC = r"(?i)\b(\d{2})\s?-\s?(TMSS|SDMS|TES|SES|SMSS|SCS)\s?-\s?(\d{2,3})\b"
# Scope packages in order, with the words of their pages; a page needs a score of three.
PACKAGES = (
    ("hv_switchgear", r"(?i)\bgis\b|gas.insulated|circuit.breakers?|disconnectors?|earthing.switch|\bsf6\b|busbar|bus.duct"),
    ("power_transformer", r"(?i)power.transformers?|\bmva\b|on.load.tap|\boltc\b|tap.changer|transformer.losses|principal.tap|windings?\b|bushings?"),
    ("mv_switchgear", r"(?i)metal.clad|metal.enclosed|air.insulated.switchgear|mv.switchgear|medium.voltage.switchgear|ring.main.unit|\brmu\b|vacuum.circuit|capacitor.banks?|(?:6\.6|11|13\.8|22|33)\s?kv.switchgear"),
    ("protection_sas", r"(?i)protection|relays?\b|\bieds?\b|substation.automation|\bsas\b|bay.control|interlock|annunciat|fault.recorder|metering|revenue.meters?|control.panels?"),
    ("communication", r"(?i)telecom|\bscada\b|\brtu\b|fib(?:er|re).optic|\bopgw\b|mpls|ethernet.switch|multiplexer|cyber|\bdvm\b|\bnms\b"),
    ("cables", r"(?i)power.cables?|\bxlpe\b|cable.terminations?|cable.joints?|termination.kits?|link.box|sheath|cable.accessor"),
    ("aux_power", r"(?i)\bdc.system|batter(?:y|ies)|chargers?\b|\bups\b|ac/dc|auxiliary.(?:power|system)|station.service.transformer|lv.switchboard|distribution.boards?|lighting|receptacles?|grounding|earthing.system"),
    ("civil", r"(?i)civil|concrete|foundations?|excavation|fence|asphalt|drainage|steel.structures?|rebars?|reinforcement.bar|pre.engineered|geotechnical|backfill|manholes?|septic"),
    ("hvac", r"(?i)\bhvac\b|air.condition|ventilation|chillers?|ductwork|exhaust.fans?|plumbing|smoke.purge"),
    ("fire", r"(?i)fire.(?:alarm|fighting|protection|suppression|detection)|fm.?200|sprinkler|deluge"),
)
LEAST_PACKAGE, PACKAGE_CHARS = 3, 8000
# Wordings of one clause in different tenders, and words that a question is not about.
SYNONYMS = (
    (r"bid bond|bid security|tender bond|bid guarantee", ("bid bond", "bid security", "tender bond", "bid guarantee", "bank guarantee")),
    (r"performance bond|performance guarantee|performance security", ("performance bond", "performance guarantee", "performance security", "bank guarantee")),
    (r"liquidated damages|delay penalt", ("liquidated damages", "delay penalty", "penalty")),
    (r"advance payment", ("advance payment", "down payment")),
    (r"retention", ("retention", "retained")),
)
ARABIC_TERMS = (
    ("ضمان ابتدائي|الضمان الابتدائي|خطاب ضمان ابتدائي|تأمين ابتدائي|التأمين الابتدائي", ("bid bond", "bid security", "tender bond")),
    ("ضمان نهائي|الضمان النهائي|تأمين نهائي|التأمين النهائي|ضمان حسن التنفيذ", ("performance bond", "performance security")),
    ("دفعة مقدمة|الدفعة المقدمة|دفعه مقدمه", ("advance payment",)),
    ("غرامة تأخير|غرامات التأخير|غرامة التأخير", ("liquidated damages", "delay penalty")),
    ("صلاحية العرض|صلاحية العطاء|مدة سريان", ("validity", "remain valid")),
    ("فترة الضمان|مدة الضمان", ("warranty period", "defects liability")),
    ("محتجزات|المحتجزات|نسبة الاستقطاع", ("retention",)),
    ("شروط الدفع|طريقة الدفع|الدفعات|السداد", ("payment terms", "payment")),
    ("آخر موعد|اخر موعد|ميعاد التقديم|موعد التقديم", ("submission", "closing date", "deadline")),
    ("زيارة الموقع", ("site visit",)),
    ("مدة التنفيذ|مدة المشروع", ("completion period", "duration", "time for completion")),
    ("غرامة|غرامات", ("penalty", "penalties")),
    ("خبرة|سنوات الخبرة", ("experience", "years")),
    ("شهادة|شهادات", ("certificate", "certified")),
    ("تأمين|التأمين", ("insurance",)),
    ("عملة|العملة", ("currency",)),
    ("محول|محولات", ("transformer",)),
    ("كابل|كابلات", ("cable",)),
    ("مقاول من الباطن|مقاولين من الباطن", ("subcontract",)),
    ("إنهاء العقد|فسخ العقد", ("termination",)),
    ("قوة قاهرة", ("force majeure",)),
)
QUESTION_WORDS = tuple(
    "what which does the this that tender with have for are how about is was our there any from and can".split()
    + "المناقصة مناقصة المناقصات اسم ايه إيه هل في من على ما ماهو ماهي هو هي إلى الى عن كام امتى فين ازاي إزاي دي ده اللي عايز".split()
)
# Voltages and ratings.
VOLTAGE, RATING = r"(?i)(\d{2,3}\s*kV)", r"(?i)(\d+\s*MVA)"
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy")


def first_rule(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first rule whose pattern a text holds; null if none does."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in rules])


def category(source: Column, summary: Column | None = None) -> Column:
    """The category by a sentence's own words, else by its summary's."""
    own = first_rule(source, CATEGORY_RULES)
    return own if summary is None else F.coalesce(own, first_rule(summary, CATEGORY_RULES))


def counted(text: Column, rules: tuple[tuple[str, str], ...], title: Column | None = None, weight: int = 1) -> Column:
    """Array of (score, -place, name): matches in the text, and weight times those in the title."""
    score = lambda p: F.regexp_count(text, F.lit(p)) + (0 if title is None else weight * F.regexp_count(title, F.lit(p)))
    return F.array(*[F.struct(score(p).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, p) in enumerate(rules)])


def discipline(title: Column, body: Column) -> Column:
    """The discipline with most matches, those in the title five times, in the body's first 6000 characters; General without any."""
    best = F.array_max(counted(F.substring(F.coalesce(body, F.lit("")), 1, 6000), DISCIPLINES, F.coalesce(title, F.lit("")), 5))
    return F.when(best["score"] > 0, best["name"]).otherwise("General")


def package(text: Column, heading: Column) -> Column:
    """The scope package of a page by its words, those of the heading four times; null below the least score."""
    best = F.array_max(counted(F.substring(text, 1, PACKAGE_CHARS), PACKAGES, heading, 4))
    return F.when(best["score"] >= LEAST_PACKAGE, best["name"])


def is_bid_item(text: Column) -> Column:
    return text.rlike(ASK) & ~text.rlike(NOT_ITEM) & ~text.rlike(EXECUTION)


def item_key(text: Column) -> Column:
    """A key of sixteen hex digits that does not depend on order, case or repeats of words longer than two."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) > 2)
    return F.substring(F.sha1(F.array_join(F.array_sort(F.array_distinct(words)), " ")), 1, 16)


def spec_ids(text: Column) -> Column:
    """Distinct specification ids such as 32-TMSS-01, sorted."""
    part = lambda g: F.regexp_extract_all(text, F.lit(SPEC), g)
    return F.array_sort(F.array_distinct(F.zip_with(F.zip_with(part(1), part(2), lambda a, b: F.concat(a, F.lit("-"), F.upper(b))), part(3), lambda a, c: F.concat(a, F.lit("-"), c))))


def levels(text: Column, pattern: str) -> Column:
    """Distinct voltages or ratings as written, without spaces, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.replace(v, F.lit(" ")))))


def date_of(text: Column) -> Column:
    """Day-first and named-month dates; null for anything else."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(text), F.lit(f))) for f in DATE_FORMATS])


def pointer(text: Column) -> Column:
    """(name, page) of an evidence pointer name#p12, by its last suffix."""
    return F.struct(F.nullif(F.regexp_extract(text, r"^(.*)#p(\d+)$", 1), F.lit("")).alias("name"), F.expr("try_cast(nullif(regexp_extract(pointer, '#p([0-9]+)$', 1), '') as int)").alias("page"))
