"""Fixed values of the corpus conventions that results depend on (formats, word lists, slot names)."""

# fixed values: slots as they may be written -> slot of the schema, per service, then for all services
SERVICE_SLOTS = {
    "train": {"time": "duration", "id": "trainid"},
    "attraction": {"fee": "entrancefee", "open": "openhours"},
    "taxi": {"car": "type"},
    "booking": {"time": "book time"},
}
SLOTS = {
    "addr": "address", "leave": "leave at", "arrive": "arrive by", "ticket": "price", "depart": "departure", "dest": "destination",
    "people": "book people", "post": "postcode", "stay": "book stay", "pricerange": "price range", "leaveat": "leave at",
    "arriveby": "arrive by", "bookstay": "book stay", "bookpeople": "book people", "booktime": "book time", "bookday": "book day",
}
SCHEMA_SLOTS = (
    "arrive by", "name", "postcode", "book stay", "price", "ref", "leave at", "stars", "address", "departure", "price range", "area",
    "entrancefee", "destination", "type", "book day", "trainid", "phone", "book time", "book people", "openhours", "day", "food",
    "internet", "duration", "parking", "choice", "department",
)

# fixed values: raw act type -> act
ACTS = {
    "inform": "Inform", "request": "Request", "recommend": "Offer", "offerbook": "Confirm", "offerbooked": "NotifySuccess",
    "nooffer": "NotifyFailure", "reqmore": "RequestAlternatives", "book": "NotifySuccess", "bye": "Goodbye", "welcome": "Greeting",
    "select": "Offer", "general": "Greeting", "greet": "Greeting", "nobook": "NotifyFailure", "thank": "ThankYou",
}

# fixed values: slot -> placeholder name in evaluation
PLACEHOLDERS = {
    "ref": "reference", "post": "postcode", "addr": "address", "fee": "price", "entrancefee": "price", "open hours": "openhours",
    "entrance fee": "price", "leave at": "leave", "arrive by": "arrive", "depart": "departure", "dest": "destination",
    "price range": "price", "book people": "people", "book time": "time", "book day": "day", "book stay": "stay", "trainid": "id",
}
UNPREFIXED = ("parking", "internet", "openhours")

# fixed values: columns that a venue table drops, and that a constraint matches approximately
IGNORED_COLUMNS = {"attraction": ("location", "openhours"), "hotel": ("location", "price", "takesbookings"), "restaurant": ("location", "introduction", "signature")}
FUZZY_COLUMNS = {"hotel": ("name",), "attraction": ("name",), "restaurant": ("name", "food"), "train": ("departure", "destination")}
#: Domains with a venue table, and constraints that hold for any venue.
TABLES = ("hotel", "restaurant", "attraction", "train")
ANY_VALUE = ("dontcare", "not mentioned", "don't care", "dont care", "do n't care", "do not care")
EVALUATED_SERVICES = ("attraction", "hotel", "restaurant", "taxi", "train")

# fixed values: evaluation slot -> names that mean it
SLOT_TOKENS = {
    "ADDRESS": ("address", "attraction_address", "hospital_address", "hotel_address", "police_address", "restaurant_address", "value_address"),
    "AREA": ("area", "value_area", "attraction_area", "restaurant_area", "hotel_area"),
    "TIME": ("booktime", "value_time", "time", "duration", "value_duration", "train_duration", "arriveby", "taxi_arriveby", "value_arrive", "arrive by", "train_arriveby", "leaveat", "value_leave", "leave at", "train_leaveat", "train_leave", "train_arrive", "taxi_leaveat", "departure_time", "departure time", "arrival time", "arrival_time"),
    "DAY": ("day", "value_day", "bookday", "train_day"),
    "PLACE": ("destination", "value_destination", "departure", "value_departure", "value_place", "train_departure", "train_destination", "taxi_destination", "taxi_departure"),
    "FOOD": ("food", "value_food", "restaurant_food"),
    "NAME": ("name", "attraction_name", "hospital_name", "hotel_name", "police_name", "restaurant_name", "value_name"),
    "PHONE": ("phone", "attraction_phone", "hospital_phone", "hotel_phone", "police_phone", "restaurant_phone", "taxi_phone", "value_phone", "restaurant_phone_number", "number"),
    "POST": ("postcode", "attraction_postcode", "hospital_postcode", "hotel_postcode", "restaurant_postcode", "value_postcode", "police_postcode"),
    "PRICE": ("price", "value_price", "entrancefee", "entrance fee", "train_price", "attraction_entrancefee", "pricerange", "value_pricerange", "price range", "restaurant_pricerange", "hotel_pricerange", "attraction_pricerange", "attraction_price"),
    "REFERENCE": ("ref", "attraction_reference", "hotel_reference", "restaurant_reference", "train_reference", "value_reference", "reference", "reference_number", "reference number", "booking_reference", "booking reference", "booking_reference_number", "hotel_ref", "restaurant_ref", "confirmation number"),
    "COUNT": ("stars", "value_stars", "hotel_stars", "bookstay", "value_stay", "stay", "bookpeople", "value_people", "people", "choice", "value_choice", "value_count", "attraction_choice", "hotel_choice", "restaurant_choice", "train_choice"),
    "TYPE": ("type", "taxi_type", "taxi_car", "value_type", "value_car", "car", "restaurant_type", "hotel_type", "attraction_type"),
    "TRAINID": ("trainid", "train_id", "value_id", "id", "train", "train_trainid"),
    "INTERNET": ("internet", "hotel_internet"),
    "PARKING": ("parking", "hotel_parking"),
    "ID": ("hospital_id", "attraction_id", "restaurant_id"),
    "DEPARTMENT": ("value_department", "department", "hospital_department"),
    "OPEN": ("openhours",),
}
# fixed values: what an unknown slot name contains (all of it) -> evaluation slot; the first that holds counts
SLOT_PARTS = (
    (("time",), "TIME"), (("reference", "number"), "REFERENCE"), (("phone",), "PHONE"), (("address",), "ADDRESS"),
    (("postcode",), "POST"), (("ref",), "REFERENCE"), (("name",), "NAME"), (("type",), "TYPE"),
)

# fixed values: written value -> canonical value
TYPES = {"swimming pool": "swimmingpool", "mutliple sports": "multiple sports", "night club": "nightclub", "guest house": "guesthouse"}
FOODS = {
    "eriterean": "mediterranean", "brazilian": "portuguese", "sea food": "seafood", "portugese": "portuguese",
    "modern american": "north american", "americas": "north american", "intalian": "italian", "italain": "italian",
    "asian or oriental": "asian", "english": "british", "australasian": "australian", "gastropod": "gastropub",
    "brutish": "british", "bristish": "british", "europeon": "european",
}
NAMES = {
    "hotel du vin bistro": "hotel du vin and bistro", "the river bar and grill": "the river bar steakhouse and grill", "nando's": "nandos",
    "city center b and b": "city center north b and b", "acorn house": "acorn guest house", "caffee uno": "caffe uno", "cafe uno": "caffe uno",
    "rosa's": "rosas bed and breakfast", "restaurant called two two": "restaurant two two", "restaurant 2 two": "restaurant two two",
    "restaurant two 2": "restaurant two two", "restaurant 2 2": "restaurant two two", "restaurant 1 7": "restaurant one seven",
    "restaurant 17": "restaurant one seven", "lime house": "limehouse", "cityrooms": "cityroomz", "whale of time": "whale of a time",
    "huntingdon hotel": "huntingdon marriott hotel", "holiday inn exlpress, cambridge": "express by holiday inn cambridge",
    "university hotel": "university arms hotel", "arbury guesthouse and lodge": "arbury lodge guesthouse", "bridge house": "bridge guest house",
    "arbury guesthouse": "arbury lodge guesthouse", "nandos in the city centre": "nandos city centre", "a and b guest house": "a and b guesthouse",
    "acorn guesthouse": "acorn guest house", "broughton gallery": "broughton house gallery", "scudamores punt co": "scudamores punting co",
    "cambridge botanic gardens": "cambridge university botanic gardens", "the junction": "junction theatre",
    "trinity street college": "trinity college", "christ college": "christ's college", "christs": "christ's college",
    "history of science museum": "whipple museum of the history of science", "parkside pools": "parkside swimming pool",
    "the botanical gardens at cambridge university": "cambridge university botanic gardens", "cafe jello museum": "cafe jello gallery",
}
TIMES = {
    "afternoon": "13:00", "lunch": "12:00", "noon": "12:00", "mid-day": "12:00", "around lunch time": "12:00", "morning": "08:00",
    "seven o'clock tomorrow evening": "07:00", "three forty five p.m": "15:45", "one thirty p.m.": "13:30", "six fourty five": "06:45", "eight thirty": "08:30",
}
TIME_STARTS = {"one o'clock p.m": "13:00", "ten o'clock a.m": "10:00"}
TEXT_VALUES = {
    "center": "centre", "caffe uno": "cafe uno", "caffee uno": "cafe uno", "christs college": "christ college", "cambridge belfy": "cambridge belfry",
    "churchill college": "churchills college", "sat": "saturday", "saint johns chop shop house": "saint johns chop house",
    "good luck chinese food takeaway": "good luck", "asian": "asian oriental", "gallery at 12": "gallery at 12 a high street",
}
TIME_SLOTS = ("leave at", "arrive by", "book time")
NAME_PREFIXES = ("the ",)
NAME_SUFFIXES = (" hotel", " restaurant", " cinema", " guest house", " theatre", " airport", " street", " gallery", " museum", " train station")
