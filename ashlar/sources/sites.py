"""Sites that are read: each a Spec, that is data. Also which platform a property's own site runs on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ashlar.functions.scalars import c
from ashlar.sources.listings import Spec

# The names that the sites give to the fields of their pages.
SITES = {
    "source_a": Spec(
        flight=True, marks=("available_units", "rental_id"),
        fields={"id": ("rental_id",), "name": ("display_name", "name", "rental_id"), "street": ("street_address", "street"), "city": ("city",), "zip": ("zip",), "lat": ("lat",), "lon": ("lon",)},
        plans=("available_units",), units=("units",),
        unit_fields={"key": ("id",), "plan_key": ("id",), "beds": ("bed",), "baths": ("bath",), "sqft": ("sqft",), "price_min": ("base_price", "price"), "price_max": ("base_price", "price_max", "price"), "total": ("total_price",), "available": ("available_on",)},
        fact_fields={"website": ("website_url",), "updated_at": ("updated_at",)},
    ),
    "source_b_plans": Spec(
        whole=True, marks=("unitTypesByBedroom",), plans=("unitTypesByBedroom.*.availableUnitTypes",), units=("units",),
        unit_fields={"key": ("unitId",), "plan_key": ("unitTypeId",), "beds": ("bedrooms",), "baths": ("fullBaths",), "sqft": ("sqft", "sqftMin"), "price_min": ("rentPrice", "rentPriceMin"), "price_max": ("rentPrice", "rentPriceMax")},
    ),
    "source_c": Spec(
        marks=("floorPlans", "urlPathname"),
        fields={"id": ("id",), "name": ("name", "addressFull"), "street": ("address",), "city": ("location.city",), "zip": ("location.zip", "zip"), "lat": ("location.lat",), "lon": ("location.lng",), "phone": ("phone",)},
        plans=("floorPlans",), units=("units",),
        unit_fields={"key": ("unitId",), "plan_key": ("id", "name"), "beds": ("bedCount",), "baths": ("bathCount",), "sqft": ("minSqft", "sqft.min"), "price_min": ("rent", "priceRange.min"), "price_max": ("rent", "priceRange.max", "priceRange.min"), "available": ("dateAvailable", "availableDate")},
    ),
    "source_d": Spec(
        marks=("floorPlans", "location"),
        fields={"id": ("metadata.typedHomeId", "typedHomeId"), "name": ("name",), "street": ("location.streetAddress",), "city": ("location.city",), "zip": ("location.zipCode",), "lat": ("location.coordinates.latitude",), "lon": ("location.coordinates.longitude",)},
        plans=("floorPlans.floorPlanGroups.*.plans",), units=("units",), skip_plan=("isRoomForRent",), skip_unit=("isRoomForRent",),
        unit_fields={"key": ("id", "name"), "plan_key": ("id", "name"), "beds": ("bedrooms.formattedValue", "bedrooms"), "baths": ("bathrooms.formattedValue", "bathrooms"), "sqft": ("floorSpace.min", "floorSpace.formattedDimension"), "price_min": ("priceRange.min", "priceRange.formattedPrice"), "price_max": ("priceRange.max", "priceRange.min"), "available": ("availabilityDate",)},
    ),
    "platform_1": Spec(
        after="Fusion.globalContent=", marks=("communityId",), plan_ref=("floorPlan.id", "id"), units=("units",),
        fields={"id": ("communityId",), "name": ("name",), "street": ("address.addressLine1",), "city": ("address.city",), "zip": ("address.zip",), "lat": ("coordinates.latitude",), "lon": ("coordinates.longitude",)},
        unit_fields={
            "key": ("unitId",), "beds": ("bedroomNumber",), "baths": ("bathroomNumber",), "sqft": ("squareFeet",), "price_min": ("startingAtPricesUnfurnished.prices.price",),
            "price_max": ("startingAtPricesUnfurnished.prices.price",), "total": ("startingAtPricesUnfurnished.prices.totalPrice",), "available": ("availableDateUnfurnished",),
        },
    ),
    "platform_2": Spec(
        script_id="jd-fp-data-script-app", marks=("floorplans",), plan_ref=("floorplan_id", "id"), plans=("floorplans",), units=("units",), plans_alone=True,
        unit_fields={
            "key": ("id_value", "id"), "plan_key": ("id",), "beds": ("bedrooms",), "baths": ("bathrooms",), "sqft": ("square_feet",), "price_min": ("price_entity.priceLow",), "price_max": ("price_entity.priceHigh", "price_entity.priceLow"),
            "available": ("available_date", "available_date_min"),
        },
        # With fees in the headline price that price is the total, and rents have fields of their own.
        instead=("price_entity.pricingReflectFees", {"price_min": ("price_entity.adjusted.low_no_fees",), "price_max": ("price_entity.adjusted.high_no_fees", "price_entity.adjusted.low_no_fees"), "total": ("price_entity.priceLow",)}),
    ),
    "platform_3": Spec(
        whole=True, marks=("units_data",), plans=("units_data.layouts",), units=("units_data.units",), plan_ref=("layoutId", "id"), skip_unit=("hidden", "leased"), need_unit=("available",),
        unit_fields={"key": ("id",), "beds": ("bedrooms",), "baths": ("bathrooms",), "sqft": ("area",), "price_min": ("displayPrice", "price"), "price_max": ("displayPrice", "price"), "available": ("availableOn",)},
    ),
    "platform_4": Spec(
        whole=True, marks=("floor_plans", "units"), fields={"id": ("id",), "name": ("asset.name",)}, plans=("floor_plans",), units=("units",), plan_ref=("floor_plan_id", "id"),
        unit_fields={"key": ("id",), "beds": ("bedroom_count",), "baths": ("bathroom_count",), "sqft": ("area",), "price_min": ("price",), "price_max": ("price",), "total": ("total_price.0", "total_price"), "available": ("available_on",)},
    ),
}

# What in a page or its address tells the platform, in the order they are tried.
PLATFORMS = {"platform_1": '(?s)Fusion\\.globalContent=.*"communityId":"AVB-', "platform_2": 'id="jd-fp-data-script-app"|(?i)<meta[^>]+name="generator"[^>]+content="Jonah Systems', "platform_3": "doorway\\.knck\\.io|knock-doorway", "platform_4": "sightmap\\.com/embed"}


def platforms(html) -> Column:
    """Array of the platforms that a page shows signs of, in order."""
    return F.filter(F.array(*(F.when(c(html).rlike(sign), name) for name, sign in PLATFORMS.items())), lambda p: p.isNotNull())
