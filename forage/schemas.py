"""Typed layouts of the tables the jobs read and write."""

MENU_ITEM = (
    "struct<item_id:string,name:string,description:string,price:double,calories:double,"
    "protein_g:double,fat_g:double,carb_g:double,diet_labels:array<string>,allergens:array<string>>"
)

RESTAURANT = (
    "restaurant_id string, name string, description string, cuisine_type string, address string, phone string, "
    "price_level int, rating double, rating_count int, geo struct<lat:double,lng:double>, "
    "diet_labels array<string>, allergens array<string>, allergen_free array<string>, "
    "business_hours array<string>, images array<string>, source string, website string, "
    f"menu_items array<{MENU_ITEM}>"
)

MAP_FEATURE = (
    "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
)

MAP_POI = (
    "id string, name string, type string, tag string, address string, tel string, location string, "
    "biz_ext struct<rating:string,cost:string>, photos array<struct<url:string>>"
)

FOOD_SEED = (
    "name_zh string, name_en string, name_pinyin string, calories double, protein_g double, fat_g double, "
    "carb_g double, sodium_mg double, fiber_g double, diet_labels array<string>"
)

SEARCH_REQUEST = (
    "query_id bigint, q string, diet_labels array<string>, price_levels array<int>, lat double, lng double, "
    "radius_km double, sort_mode string, offset int, limit int, user_id bigint"
)

DIET_PROFILE = (
    "user_id bigint, diet_labels array<string>, allergens array<string>, calorie_goal int, protein_goal_g double, "
    "fat_goal_g double, carb_goal_g double, price_pref int, cuisine_prefs array<string>, updated_at timestamp"
)

FOOD_LOG = (
    "id bigint, user_id bigint, log_date date, meal_type string, food_id bigint, food_name string, "
    "quantity_g double, calories_kcal double, protein_g double, fat_g double, carb_g double, created_at timestamp"
)

FEEDBACK = (
    "id bigint, user_id bigint, query_text string, restaurant_id string, rank_position int, is_relevant boolean, "
    "comment string, created_at timestamp"
)
